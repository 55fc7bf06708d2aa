"""Line dedup across documents: a segment-partition edit join finds repeated and nearly repeated lines.

A line of at least ``min_chars`` characters goes when it occurs earlier, word for word, or when a line within ``edits`` edits
(insert, delete, substitute a character) occurs earlier; "earlier" compares (doc_id, hash of the text, line number) of first
occurrences.
A shorter line has too few characters for near matches: it goes only when it occurs earlier, word for word, holds at least
``exact_chars`` characters between blanks (as many as ``min_chars`` unless given) and occurs in ``exact_docs`` documents or
more. Still shorter ones (braces, blank lines) always stay.

1. Candidate lines: each distinct line is split into ``edits + 1`` segments. Two lines within that many edits share a segment
   at nearly the same place, so that the hashes of a line's segments meet the hashes of the few substrings that a line of
   the same or a little greater length can match them with (by length, segment and shift). Substring hashes come from prefix
   sums over a block of text. Only hashes travel.
2. The candidates' texts are fetched by a second pass behind a bit filter of fixed size (``FILTER_BITS``; a full filter lets
   more through, the join after it is exact) and meet their segment's other lines in one task, earliest first. A line found
   to be late is not compared again, so that a group of near copies costs about one comparison each and no pairs are
   written. Character counts rule out most of the rest, a banded bit-parallel edit distance over many pairs at once decides.
   Segments with more than ``RUN_LINES`` lines are cut into blocks, and pairs of blocks meet.
3. Repeats are counted with native hashes of 96 bits; the dropped line numbers of a document join its text once.

Rows with a null doc_id or text pass unchanged and are compared with nothing. Rows that share doc_id and text are one document (all of
them keep or lose the same lines); different texts under one doc_id are documents of their own. An empty text stays. Further
columns pass through, but for those with the name of a result or beginning with _ld_.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .ngram_join import _runs
from .shared import materialise

MIN_CHARS, EDITS, EXACT_CHARS = 24, 2, 4
FILTER_BITS = 26
_SALT = np.uint64(0xD6E8FEB86659FD93)
RUN_LINES = 4096  # lines of a segment that meet in one task
RUN_ROWS = 1_000_000  # rows of a segment that a task holds at once
_CLASSES = 64


def _lines(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, starts, ends, hashes) of the lines of at least so many characters, by block."""
    for _, _, data, where in tb.blocks(column):
        if not len(data):
            continue
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[where]
        breaks = np.flatnonzero(cp == 10)
        starts = np.concatenate((at[:-1], breaks + 1))
        ends = np.concatenate((at[1:], breaks))
        starts, ends = np.sort(starts), np.sort(ends)
        keep = ends - starts >= least
        starts, ends = starts[keep], ends[keep]
        if len(starts):
            value = tb.mix(cp.astype(np.uint64) + _SALT)
            yield cp, starts, ends, tb.range_hashes(value, starts, ends)


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, size) of the edits + 1 segments of lines of these lengths; the last ones are a character longer."""
    n = edits + 1
    size, more = length // n, length % n
    out, place = [], np.zeros_like(length)
    for i in range(n):
        own = size + (i >= n - more)
        out.append((place, own))
        place = place + own
    return out


def _segment_rows(edits: int, least: int):
    """Rows (token, line): line's last two bits say whether the row is a segment (1), a substring to match (2) or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for cp, starts, ends, code in _lines(batch.column("text"), least):
                line, first = np.unique(code & ~np.uint64(3), return_index=True)
                fresh = np.array([x not in seen for x in line.tolist()], bool)
                if len(seen) < 1_000_000:
                    seen.update(line.tolist())
                line, first = line[fresh], first[fresh]
                if not len(line):
                    continue
                starts, length = starts[first], (ends - starts)[first]
                value = tb.mix(cp.astype(np.uint64) + _SALT)
                up, down = tb._powers(len(value) + 1)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[: len(value)], dtype=np.uint64)))
                tokens, lines = [], []

                def add(s: np.ndarray, size: np.ndarray, at_length: np.ndarray, i: int, role: int, ok: np.ndarray, total=total, down=down, line=line, tokens=tokens, lines=lines) -> None:
                    key = tb.mix((total[(s + size)[ok]] - total[s[ok]]) * down[s[ok]] + tb.mix((at_length[ok] * 16 + i).astype(np.uint64)))
                    tokens.append(key)
                    lines.append(line[ok] | np.uint64(role))

                for less in range(edits + 1):
                    other = length - less
                    for i, (place, size) in enumerate(segments(other, edits)):
                        low = max(-i, less - (edits - i))
                        high = min(i, less + (edits - i))
                        for shift in range(low, high + 1):
                            ok = (other >= least) & (place + shift >= 0) & (place + shift + size <= length)
                            add(starts + place + shift, size, other, i, 3 if not less and not shift else 2, ok)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(np.concatenate(tokens))), pa.array(tb.signed(np.concatenate(lines)))], ["token", "line"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, line, block, blocks) of tokens under which a segment and another line's substring meet; rows come by token, line.

    A run too long for memory comes in parts: its rows have no blocks yet, and a row without a line tells them at its end.
    """
    open_: tuple[int, int, int] | None = None  # token of such a run, lines so far, last line

    def rows(token: np.ndarray, line: np.ndarray, block: np.ndarray, blocks: np.ndarray | None) -> pa.RecordBatch:
        held = pa.nulls(len(token), pa.int64()) if blocks is None else pa.array(blocks)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(line), pa.array(block), held], ["token", "line", "block", "blocks"])

    def closed(run: tuple[int, int, int]) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([run[0]], pa.int64()), none, none, pa.array([-(-run[1] // RUN_LINES)], pa.int64())], ["token", "line", "block", "blocks"])

    for part in _runs(batches, RUN_ROWS):
        token, line = part.column("token").to_numpy(), part.column("line").to_numpy()
        if open_ is not None and open_[0] != token[0]:
            yield closed(open_)
            open_ = None
        if open_ is not None or (len(token) > RUN_ROWS and token[0] == token[-1]):
            before, last = (open_[1], open_[2]) if open_ is not None else (0, None)
            distinct = np.unique(line[token == token[0]] & ~3)
            if last is not None and len(distinct) and distinct[0] == last:
                distinct = distinct[1:]
            if len(distinct):
                open_ = (int(token[0]), before + len(distinct), int(distinct[-1]))
                yield rows(np.full(len(distinct), token[0]), distinct, (before + np.arange(len(distinct))) // RUN_LINES, None)
            rest = token != token[0]
            if not rest.any():
                continue
            if open_ is not None:
                yield closed(open_)
                open_ = None
            token, line = token[rest], line[rest]
        cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        out = []
        for k in np.flatnonzero(np.diff(cuts) > 1):
            run = line[cuts[k] : cuts[k + 1]]
            distinct = np.unique(run & ~3)
            if len(distinct) > 1 and (run & 1).any():
                out.append((np.full(len(distinct), token[cuts[k]]), distinct, np.arange(len(distinct)) // RUN_LINES, np.full(len(distinct), -(-len(distinct) // RUN_LINES))))
        if out:
            yield rows(*(np.concatenate(x) for x in zip(*out, strict=True)))
    if open_ is not None:
        yield closed(open_)


def _fetch(bits: np.ndarray, least: int):
    """(line, value) of the distinct lines that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for cp, starts, ends, code in _lines(batch.column("text"), least):
                line = code & ~np.uint64(3)
                spot = (line >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hit = np.flatnonzero((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1)
                hit = [i for i in hit.tolist() if int(line[i]) not in seen and not (len(seen) < 1_000_000 and seen.add(int(line[i])))]
                if hit:
                    texts = [cp[starts[i] : ends[i]].tobytes().decode("utf-32-le") for i in hit]
                    yield pa.RecordBatch.from_arrays([pa.array(tb.signed(line[hit])), pa.array(texts, pa.string())], ["line", "value"])

    return run


def banded_distance(a: list[str], b: list[str], limit: int) -> np.ndarray:
    """Edit distances of a[i] and b[i], or limit + 1 where they are greater; all at once, one character a step.

    A 64-bit word holds the vertical differences of a column near the diagonal; characters outside the band count as
    different, which leaves distances up to the limit as they are.
    """
    # an equal beginning leaves distances as they are and gives the band room
    a, b = ["\0" * limit + x for x in a], ["\0" * limit + x for x in b]
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = int(max(la.max(), lb.max())) + 2 * limit + 2
    first, second = np.zeros((n, width), np.uint32), np.zeros((n, width), np.uint32)
    for row, (x, y) in enumerate(zip(a, b, strict=True)):
        first[row, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.uint32) + np.uint32(1)
        second[row, : len(y)] = np.frombuffer(y.encode("utf-32-le"), np.uint32) + np.uint32(1)
    one = np.uint64(1)
    vp = np.full(n, (((1 << 64) - 1) << (64 - limit - 1)) & ((1 << 64) - 1), np.uint64)
    vn = np.zeros(n, np.uint64)
    dist = np.full(n, limit, np.int64)
    row_bit = np.full(n, 1 << 62, np.uint64)
    for i in range(int(lb.max())):
        match = np.zeros(n, np.uint64)
        for t in range(2 * limit + 1):
            at = i + limit - t
            if at >= 0:
                match |= (first[:, at] == second[:, i]).astype(np.uint64) << np.uint64(63 - t)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        active = i < lb
        diagonal = i < la - limit
        dist += np.where(active & diagonal, (d0 >> np.uint64(63)) == 0, 0)
        level = active & ~diagonal
        dist += np.where(level, ((hp & row_bit) != 0).astype(np.int64) - ((hn & row_bit) != 0), 0)
        row_bit = np.where(level, row_bit >> one, row_bit)
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
    dist[np.abs(la - lb) > limit] = limit + 1
    return np.minimum(dist, limit + 1)


def _late_of_run(texts: list[str], edits: int) -> np.ndarray:
    """Which texts have an earlier one within so many edits."""
    n, size = len(texts), np.array([len(x) for x in texts])
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum(size)))
    counts = np.bincount(np.repeat(np.arange(n), size) * _CLASSES + cp % _CLASSES, minlength=n * _CLASSES).reshape(-1, _CLASSES).astype(np.int32)
    late = np.zeros(n, bool)
    for i in range(n - 1):
        j = np.flatnonzero(~late[i + 1 :] & (np.abs(size[i + 1 :] - size[i]) <= edits)) + i + 1
        # an edit changes the counts of at most two characters by one each
        j = j[np.abs(counts[j] - counts[i]).sum(1) <= 2 * edits]
        if not len(j):
            continue
        # what two texts begin and end with alike needs no edits
        a, middles = cp[at[i] : at[i + 1]], []
        for k in j.tolist():
            b = cp[at[k] : at[k + 1]]
            short = min(len(a), len(b))
            head = a[:short] != b[:short]
            p = int(head.argmax()) if head.any() else short
            tail = a[len(a) - short + p :][::-1] != b[len(b) - short + p :][::-1]
            q = int(tail.argmax()) if tail.any() else short - p
            middles.append((texts[i][p : len(a) - q], texts[k][p : len(b) - q]))
        late[j] |= banded_distance([x for x, _ in middles], [y for _, y in middles], edits) <= edits
    return late


def _late(edits: int):
    """Lines (h, g) of runs that have an earlier line within so many edits; rows come earliest first within a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            token, value = part.column("token").to_numpy(), part.column("value").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            found: list[np.ndarray] = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s < 2:
                    continue
                found.append(np.flatnonzero(_late_of_run(value[s:e], edits)) + s)
            rows = np.concatenate(found) if found else np.empty(0, np.int64)
            if len(rows):
                yield from part.take(pa.array(rows)).select(["h", "g"]).to_batches()

    return run


def late_lines(docs: DataFrame, first: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g) of the distinct lines that have an earlier line within so many edits.

    docs: text. first: (h, g, first), the hashes and the first place of every distinct line.
    """
    if min_chars <= edits:
        raise ValueError("lines must be longer than the edits between them")
    texts = docs.select("text").where("text is not null")
    rows = texts.mapInArrow(_segment_rows(edits, min_chars), "token long, line long")
    runs = materialise(rows.repartition("token").sortWithinPartitions("token", "line").mapInArrow(_meet, "token long, line long, block long, blocks long"))
    long = runs.where("line is null").select("token", "blocks")
    met = runs.where("line is not null and blocks is not null").unionByName(runs.where("line is not null and blocks is null").drop("blocks").join(long, "token"))
    # one byte of the filter holds eight neighbouring hash prefixes
    spot = F.shiftrightunsigned("line", 64 - FILTER_BITS)
    used = runs.where("line is not null").select(spot.alias("s")).groupBy((F.col("s") / 8).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(s % 8 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bits[used.column("at").to_numpy()] = used.column("bits").to_numpy()
    value = texts.mapInArrow(_fetch(bits, min_chars), "line long, value string").groupBy("line").agg(F.first("value").alias("value"))
    named = value.select("line", "value", F.xxhash64("value").alias("h"), F.hash("value").alias("g")).join(first, ["h", "g"])
    dealt = met.withColumnRenamed("block", "own").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("token"), "line")
    texts_of = dealt.join(named, "line").select("token", "h", "g", "first", "value").repartition("token").sortWithinPartitions("token", "first")
    return texts_of.select("token", "h", "g", "value").mapInArrow(_late(edits), "h long, g int").distinct()


def _occurrences(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """(doc_id, key, line_no, h, g, short) of the lines that are compared; key tells texts of the same doc_id apart."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    short = F.length("line") < min_chars
    kept = lines.where(~short | (F.length(F.trim("line", F.lit(" \t\r"))) >= exact_chars)) if exact_chars < min_chars else lines.where(~short)
    return kept.select("doc_id", "key", "line_no", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), short.alias("short"))


_PLACE = ("doc_id", "key", "line_no")


def _first_places(seen: DataFrame, exact_docs: int) -> DataFrame:
    """(h, g, first, n) of the distinct lines; of short ones, those in at least so many documents."""
    place, n = F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n")
    if exact_docs <= 1:
        return seen.groupBy("h", "g").agg(place, n)
    by_doc = seen.where("short").groupBy("h", "g", "doc_id", "key").agg(F.min("line_no").alias("line_no"), n)
    many = by_doc.groupBy("h", "g").agg(place, F.sum("n").alias("n"), F.count("*").alias("n_docs")).where(F.col("n_docs") >= exact_docs)
    return seen.where("not short").groupBy("h", "g").agg(place, n).union(many.drop("n_docs"))


def dropped_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None, exact_docs: int = 1) -> DataFrame:
    """(doc_id, key, line_no) of the lines that occur, or nearly occur, earlier; key is xxhash64 of the document's text."""
    seen = _occurrences(docs, min_chars, min_chars if exact_chars is None else exact_chars)
    first = materialise(_first_places(seen, exact_docs))
    late = late_lines(docs.where("doc_id is not null"), first.select("h", "g", "first"), edits, min_chars).withColumn("late", F.lit(True))
    rule = materialise(first.join(late, ["h", "g"], "left").where("n > 1 or late").select("h", "g", "first", "late"))
    return seen.join(rule, ["h", "g"]).where(F.col("late") | (F.struct(*_PLACE) != F.col("first"))).select(*_PLACE)


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None, exact_docs: int = 1) -> DataFrame:
    """docs with text without its dropped lines, n_lines (before) and n_dropped; both are 0 for a null text."""
    docs = docs.drop("n_lines", "n_dropped", "_ld_key", "_ld_gone", "_ld_lines")
    gone = dropped_lines(docs, edits, min_chars, exact_chars, exact_docs).distinct().groupBy("doc_id", F.col("key").alias("_ld_key")).agg(F.collect_list("line_no").alias("_ld_gone"))
    out = docs.withColumn("_ld_key", F.xxhash64("text")).join(gone, ["doc_id", "_ld_key"], "left").withColumn("_ld_lines", F.split("text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), F.col("_ld_gone")), lambda i: F.get(F.col("_ld_lines"), i))
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counts = {"n_lines": F.greatest(F.coalesce(F.size("_ld_lines"), F.lit(0)), F.lit(0)), "n_dropped": F.greatest(F.coalesce(F.size("_ld_gone"), F.lit(0)), F.lit(0))}
    return out.withColumns({**counts, "text": text}).select(*docs.columns, *counts)
