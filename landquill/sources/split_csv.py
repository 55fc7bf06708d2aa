"""Rows of large CSV files, one file by many tasks.

Spark's text reader cuts a file into byte ranges at line feeds, which none of the encodings has inside a character. Whether a range starts inside a
quoted cell is only known from the ranges before it; so the first pass tells, for each range, in which state it ends if it
starts outside of quotes, and if it starts inside, as well as which encodings read it. Composed in the order of ranges these give each one's
true start, and each file's encoding. The second pass parses every range from its true start. A row that goes over the end of a range is
sent in pieces; those, two for each range at most, are put together by file.

What the driver holds is one small row for each range, as Spark's own list of file splits.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import materialise
from .files import ENCODINGS, SIDE_FILES

_MARK = b"\xef\xbb\xbf"  # fixed value: the byte-order mark that the text reader drops
_START, _PLAIN, _QUOTED, _AFTER = range(4)


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line, as csv.reader takes quotes: only at the start of a cell do they open one."""
    if b'"' not in line:
        return inside
    state = _QUOTED if inside else _START
    for c in line:
        if state == _QUOTED:
            if c == 34:
                state = _AFTER
        elif c == 44 or c == 13:
            state = _START
        elif c == 34 and state in (_START, _AFTER):
            state = _QUOTED
        else:
            state = _PLAIN
    return state == _QUOTED


def _reads(blob: bytes, encoding: str) -> bool:
    try:
        blob.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """(file, start, size, lines) of the runs of lines of one range; a range can come in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("file"), batch.column("start").to_pylist()
        names, lines, size = files.to_pylist(), batch.column("line").to_pylist(), batch.column("size").to_pylist()
        a = 0
        for b in range(1, len(lines) + 1):
            if b == len(lines) or starts[b] != starts[a] or names[b] != names[a]:
                yield names[a], starts[a], size[a], lines[a:b]
                a = b


def _summaries(encodings: tuple[str, ...]):
    """(file, start, size, outside, inside, bytes, reads): the state at the end of each range from both starts, its length with line feeds, and what reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "size": now[2], "outside": state[0], "inside": state[1], "bytes": state[2], "reads": state[3]}])

        for name, start, size, lines in _ranges(batches):
            if now != (name, start, size):
                if now is not None:
                    yield out()
                now, state = (name, start, size), [False, True, 0, [True] * len(encodings)]
            for line in lines:
                if b'"' in line:
                    state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
            blob = b"\n".join(lines)
            state[2] += len(blob) + 1
            state[3] = [ok and _reads(blob, e) for ok, e in zip(state[3], encodings, strict=True)]
        if now is not None:
            yield out()

    return run


def _plan(encodings: tuple[str, ...], strict: bool):
    """One file's ranges in order: where each really starts and ends, the file's encoding, and whether a byte-order mark stood in front."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start")
        inside, rows = False, []
        missing = int(part["size"].iloc[0]) - int(part["bytes"].sum())
        marked = missing >= 2  # 0 or -1 without a mark
        fed = missing in (0, 3)  # a line feed ends the file
        readable = [all(r[k] for r in part.reads) for k in range(len(encodings))]
        if marked and readable[0]:
            # with the mark in front, does the first range's start still read as the first encoding?
            readable[0] = _reads(_MARK + b"\n", encodings[0])
        found = encodings[0] if not strict else next((e for e, ok in zip(encodings, readable, strict=True) if ok), None)
        for r in part.itertuples():
            after = r.inside if inside else r.outside
            rows.append((r.file, r.start, inside, bool(after), found, marked, fed and r.Index == part.index[-1]))
            inside = bool(after)
        return pd.DataFrame(rows, columns=["file", "start", "begins", "ends", "encoding", "marked", "feed"])

    return run


def parsed(text: str) -> list[tuple[int, list[str]]]:
    """(line feeds before it, cells) of each row of a CSV text."""
    csv.field_size_limit(sys.maxsize)
    pieces = list(io.StringIO(text, newline=""))
    feeds, seen = [0], 0
    for p in pieces:
        seen += p.endswith("\n")
        feeds.append(seen)
    reader, out, before = csv.reader(iter(pieces)), [], 0
    for cells in reader:
        out.append((feeds[before], cells))
        before = reader.line_num
    return out


def _rows(plan: dict[tuple[str, int], tuple[bool, str, bool, list]], strict: bool):
    """(file, line_idx, fields, piece, opens): whole rows, and pieces of rows that go over the border of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, place, held, tail = None, False, 0, [], False

        def emit(lines: list[tuple[int, bytes]], whole: bool) -> pa.RecordBatch:
            text = b"\n".join(x for _, x in lines).decode(plan[now][1], "strict" if strict else "replace")
            if whole:
                text += "\n"
            else:
                return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([lines[0][0]]), pa.array([None], pa.list_(pa.string())), pa.array([text]), pa.array([not tail])], names)
            rows, last, same, at = parsed(text), -1, 0, []
            for feeds, _ in rows:
                same = same + 1 if feeds == last else 0
                last = feeds
                at.append(lines[feeds][0] + same)
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * n, pa.string()), pa.array(at, pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string())), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())], names)

        names = ["file", "line_idx", "fields", "piece", "opens"]
        for name, start, _, lines in _ranges(batches):
            if now != (name, start):
                if held:
                    yield emit(held + plan[now][3], False)
                if (name, start) not in plan:
                    raise RuntimeError(f"the ranges of {name} have changed between two passes")
                now, held = (name, start), []
                inside, place = plan[now][0], start + (start > 0)
                tail = inside
                if start == 0 and plan[now][2]:
                    lines = [_MARK + lines[0], *lines[1:]]
            ready: list[tuple[int, bytes]] = []
            for line in lines:
                held.append((place, line))
                place += len(line) + 1
                inside = ends_inside(line, inside)
                if not inside:
                    if tail:
                        yield emit(held, False)
                        tail = False
                    else:
                        ready += held
                    held = []
            if ready:
                yield emit(ready, True)
        if held:
            yield emit(held + plan[now][3], False)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, at, text in zip(*(batch.column(c).to_pylist() for c in ("file", "line_idx", "text")), strict=True):
            rows = parsed(text)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([at + k for k in range(len(rows))], pa.int64()), pa.array([c for _, c in rows], pa.list_(pa.string()))], ["file", "line_idx", "fields"])


def split_csv_rows(spark: SparkSession, path: str, pattern: str = "*.csv", encodings: tuple[str, ...] = ENCODINGS, strict: bool = True) -> DataFrame:
    """(file, line_idx, fields): the rows of CSV files, as files.csv_rows gives them, with each file read by many tasks.

    line_idx ascends in a file and is 0 for its first row (it follows the bytes, and is not without gaps). file is the name without its folder, which
    names have to be told apart by. An encoding must read the whole file; strict=False takes the first and replaces what it cannot read. An empty file has no rows.
    """
    pinned = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(pinned, None)
    # both passes have to cut files alike, whatever executors come or go between them
    spark.conf.set(pinned, before or str(spark.sparkContext.defaultParallelism))
    try:
        text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(path)
        name = F.col("_metadata.file_name")
        lines = text.select(name.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")).where(~F.col("file").rlike(SIDE_FILES))
        told = lines.mapInArrow(_summaries(encodings), "file string, start long, size long, outside boolean, inside boolean, bytes long, reads array<boolean>")
        planned = told.groupBy("file").applyInPandas(_plan(encodings, strict), "file string, start long, begins boolean, ends boolean, encoding string, marked boolean, feed boolean").collect()
        for r in planned:
            if r["encoding"] is None:
                raise ValueError(f"none of {', '.join(encodings)} reads {r['file']}")
        plan = {(r["file"], r["start"]): (r["begins"], r["encoding"], r["marked"], [(0, b"")] if r["feed"] else []) for r in planned}
        rows = materialise(lines.mapInArrow(_rows(plan, strict), "file string, line_idx long, fields array<string>, piece string, opens boolean"))
    finally:
        if before is None:
            spark.conf.unset(pinned)
        else:
            spark.conf.set(pinned, before)
    # two pieces for each range at most
    order = Window.partitionBy("file").orderBy("line_idx")
    pieces = rows.where("piece is not null").withColumn("of", F.last(F.when(F.col("opens"), F.col("line_idx")), ignorenulls=True).over(order))
    whole = pieces.groupBy("file", F.col("of").alias("line_idx")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "piece"))), lambda p: p["piece"]), "\n").alias("text"))
    return rows.where("piece is null").select("file", "line_idx", "fields").unionByName(whole.mapInArrow(_joined, "file string, line_idx long, fields array<string>"))
