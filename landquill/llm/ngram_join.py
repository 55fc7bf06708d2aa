"""N-gram Jaccard join: a prefix-tree join over globally ordered sets of word n-grams.

How it runs
-----------
1. One pass over the texts gives each row's set size, a 128-bit hash of its set and a sketch (how many n-grams fall into each
   of 256 ranges of hash values, modulo 16; for long texts more ranges), and counts of n-grams that are frequent within a task.
   Equal sets become one node with an id of its own; the rest of the work is on nodes.
2. Global order of n-grams: rare ones by hash, then a bounded list of the most frequent ones, rarer first. An order key of 64
   bits holds it. Any total order gives the same links; this one keeps passages that many documents share at the end.
3. Two linked sets of n and n' n-grams have their first common n-gram (in the global order) within the first
   ``n - ceil(t n) + 1`` of either. All of these are dealt out with their place and size; what meets nobody whose size fits,
   or whose n-grams from that place on are too few, goes. The rest meet their sketches: the sum of the circular
   differences of two sketches is never above the true symmetric difference, so that pairs above the allowed one are dropped
   safely. This is done twice: with the first few n-grams (``first_part``), which join nearly all of what belongs together, and
   then with all of them, where only n-grams that different groups share are left. N-grams with more than ``RUN_ROWS`` nodes
   are cut into blocks, and pairs of blocks meet. The result is a set of candidate groups that hold every link.
4. Each candidate group's sets travel once. In a task they are stored in a path-compressed trie in the global order (an edge
   holds the n-grams of one range of order keys), and each set walks down it with the overlap so far; subtrees whose overlap plus
   what can remain is too small are pruned. Groups with many n-grams are cut into blocks, and pairs of blocks are joined, so that
   no task holds an unbounded group. Members that are already connected are not compared again.

Inputs: any documents table with doc_id and text; other columns are ignored. Null or empty texts, and texts of white
space only, have an empty set and link with nothing. Each row is judged by its own text, also where rows share a doc_id. A null
doc_id never becomes a component's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .shared import components, materialise

RANGES = 256  # of hash values, in a sketch of 4 bits each, at least
PER_RANGE = 8  # n-grams of a range, about, in longer sketches
LEVEL_BITS = 4
LEVELS = 1 << LEVEL_BITS  # of the trie: ranges of order keys, one edge each
BLOCK_GRAMS = 2_000_000  # n-grams of a block of a candidate group
RUN_ROWS = 4096  # nodes of an n-gram that meet in one task
NEAR_ROWS = 32  # so many neighbours of a run are tested for sizes and places; in longer runs every row stays
FREQUENT = 100_000  # n-grams in the list of frequent ones, at most
LOCAL_LEAST = 8  # documents of a task in which an n-gram counts as frequent there
_FLUSH = 4_000_000
_PART = 200_000
_HALF = np.uint64(1 << 63)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, n-gram hashes, offsets) of blocks of a batch with a text column."""
    for first, last, data, where in tb.blocks(batch.column("text")):
        yield (np.arange(first, last), *tb.sorted_sets(*tb.shingles(*tb.words(data, where), k)))


def _ranges(n: int) -> int:
    """Ranges of the sketch of n n-grams: a power of two."""
    return max(RANGES, 1 << (n // PER_RANGE).bit_length())


def _sketch(grams: np.ndarray) -> bytes:
    """Counts by range, modulo 16, two to a byte: those of even ranges in the low bits."""
    ranges = _ranges(len(grams))
    counts = np.bincount((grams >> np.uint64(65 - ranges.bit_length())).astype(np.int64), minlength=ranges).astype(np.uint8) & 15
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _coarse(packed: bytes, ranges: int) -> np.ndarray:
    """Counts modulo 16 of a sketch over fewer ranges."""
    raw = np.frombuffer(packed, np.uint8)
    counts = np.stack((raw & 15, raw >> 4), 1).ravel()
    return (counts.reshape(ranges, -1).sum(1, dtype=np.uint32) & 15).astype(np.int8)


def prefix_length(n: int, num: int, den: int) -> int:
    """N-grams of a set of n among which its first common one with any linked set is."""
    return n - -(-num * n // den) + 1


def first_part(num: int, den: int) -> int:
    """N-grams of a set that are tried first: hardly any linked pair has none of them in common. What they miss, the rest finds."""
    return int(np.ceil(-9 / np.log10((den - num) / den))) if num < den else 1


def _hashes(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    mixed = tb.mix(grams)
    return tb.signed(tb.row_sums(mixed, at)), tb.signed(tb.row_sums(tb.mix(mixed + np.uint64(1)), at))


def _profile(k: int):
    names = ["token", "doc_id", "text_key", "n", "h1", "h2", "sketch"]
    schema = pa.schema([*((c, pa.int64()) for c in names[:-1]), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for rows, grams, at in _sets(batch, k):
                own = batch.take(pa.array(rows)).select(["doc_id", "text_key"])
                sketches = pa.array([_sketch(grams[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), *own.columns, pa.array(np.diff(at)), *map(pa.array, _hashes(grams, at)), sketches], schema=schema)
                waiting.append(grams)
                held += len(grams)
                if held > _FLUSH:
                    yield from frequent(waiting)
                    waiting, held = [], 0
        if waiting:
            yield from frequent(waiting)

    def frequent(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        values, counts = values[counts >= LOCAL_LEAST], counts[counts >= LOCAL_LEAST]
        if len(values):
            none = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(tb.signed(values)), none, none, pa.array(counts), none, none, pa.nulls(len(values), pa.binary())], schema=schema)

    return run, "token long, doc_id long, text_key long, n long, h1 long, h2 long, sketch binary"


class Order:
    """The global order of n-grams as keys of 64 bits: rare ones by hash in the lower half, frequent ones by rank in the upper."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        place = np.empty(len(tokens), np.uint64)
        place[np.lexsort((tokens, counts))] = np.arange(len(tokens))
        by_token = np.argsort(tokens)
        self.tokens = tokens[by_token]
        self.keys = _HALF + place[by_token] * np.uint64((1 << 63) // max(1, len(tokens)))

    def sorted_keys(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Order keys of sets of ascending hashes, ascending in each set."""
        keys = grams >> np.uint64(1)
        if not len(self.tokens) or not len(grams):
            return keys
        spot = np.minimum(np.searchsorted(self.tokens, grams), len(self.tokens) - 1)
        known = self.tokens[spot] == grams
        keys[known] = self.keys[spot[known]]
        for i in np.unique(np.searchsorted(at, np.flatnonzero(known), "right") - 1).tolist():
            keys[at[i] : at[i + 1]].sort()
        return keys


def _prefixes(k: int, num: int, den: int, order: Order):
    """Rows (token, node, n, place) of the sets' first n-grams; node: a hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, grams, at in _sets(batch, k):
                size, node, keys = np.diff(at), _hashes(grams, at)[0], order.sorted_keys(grams, at)
                fresh = []
                for i in np.flatnonzero(size).tolist():
                    key = int(node[i])
                    if key not in seen:
                        seen.add(key)
                        fresh.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not fresh:
                    continue
                rows = np.array(fresh)
                held = np.array([prefix_length(int(n), num, den) for n in size[rows]])
                total = np.concatenate(([0], np.cumsum(held)))
                place = np.arange(total[-1]) - np.repeat(total[:-1], held)
                token = keys[np.repeat(at[rows], held) + place]
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(token)), pa.array(np.repeat(node[rows], held)), pa.array(np.repeat(size[rows], held).astype(np.int32)), pa.array(place.astype(np.int32))], ["token", "node", "n", "place"])

    return run, "token long, node long, n int, place int"


def _runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole runs of equal tokens, from batches in token order; a run of over most rows comes in parts."""
    rest: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column("token").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest, held = [], 0
        elif rest and (rest[-1].column("token")[0].as_py() != token[-1] or (most and held > most)):
            yield pa.Table.from_batches(rest)
            rest, held = [], 0
        rest.append(batch.slice(last))
        held += batch.num_rows - last
    if rest:
        yield pa.Table.from_batches(rest)


def _met(num: int, den: int):
    """Rows (token, node, place) of n-grams that several nodes hold, without those whose neighbours in the run all are too small, too large
    or too far on; rows come by token, then node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for part in _runs(batches, _PART):
            token, node, size, place = (part.column(c).to_numpy() for c in ("token", "node", "n", "place"))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            # the next part of a run that is too long for one: all of it stays
            begin = token[0]
            late = end is not None and end[0] == begin
            if late and end[1] == node[0]:
                fresh[0] = False
            end = (int(token[-1]), int(node[-1]))
            kept = np.flatnonzero(fresh)
            token, size, place = token[kept], size[kept].astype(np.int64), place[kept]
            stays = np.zeros(len(token), bool)
            for d in range(1, min(NEAR_ROWS, len(token) - 1) + 1):
                a = np.flatnonzero(token[d:] == token[:-d])
                if not len(a):
                    break
                b = a + d
                need = -(-num * (size[a] + size[b]) // (num + den))
                fits = (np.minimum(size[a], size[b]) * den >= num * np.maximum(size[a], size[b])) & (np.minimum(size[a] - place[a], size[b] - place[b]) >= need)
                stays[a[fits]] = stays[b[fits]] = True
                if d == NEAR_ROWS:
                    long = np.isin(token, token[a])
                    stays |= long
            if late:
                stays |= token == begin
            elif len(token) > _PART and token[0] == token[-1]:
                stays[:] = True
            if stays.any():
                yield from part.take(pa.array(kept[stays])).select(["token", "node", "place"]).to_batches()

    return run


class Forest:
    """Union-find over 0..n-1; unions come as arrays. root: the tree that each member is in from the start."""

    def __init__(self, n: int, root: np.ndarray | None = None):
        self.root = np.arange(n)
        if root is not None and n:
            _, first, which = np.unique(root, return_index=True, return_inverse=True)
            self.root = first[which]
        self.links: list[tuple[int, int]] = []

    def union(self, a: int, others: np.ndarray) -> None:
        others = others[self.root[others] != self.root[a]]
        if len(others):
            roots, first = np.unique(self.root[others], return_index=True)
            self.links += [(a, int(b)) for b in others[first]]
            # the joined trees take their smallest root
            roots = np.append(roots, self.root[a])
            joined = np.zeros(len(self.root), bool)
            joined[roots] = True
            self.root[joined[self.root]] = roots.min()

    def apart(self, a: int) -> np.ndarray:
        """Later members that are not connected with a."""
        return np.flatnonzero(self.root[a + 1 :] != self.root[a]) + a + 1


def _differences(num: int, den: int, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of linked sets with a and b members: overlap >= num (a + b) / (num + den)."""
    return a + b - 2 * -(-num * (a + b) // (num + den))


def _candidates(num: int, den: int):
    """Forest of the pairs that share a token, have fitting sizes and close sketches, and are in no group together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            token, ids, size, group = (part.column(c).to_numpy() for c in ("token", "id", "n", "component"))
            packed = part.column("sketch").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            out = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e - s > 1:
                    forest = Forest(e - s, group[s:e])
                    cached: dict[int, np.ndarray] = {}
                    for a in range(e - s - 1):
                        b = forest.apart(a)
                        b = b[(np.minimum(size[s + b], size[s + a]) * den >= num * np.maximum(size[s + b], size[s + a]))]
                        if len(b):
                            ranges = _ranges(int(min(size[s + a], size[s + b].min())))
                            if ranges not in cached:
                                fine = np.flatnonzero([2 * len(packed[s + i]) >= ranges for i in range(e - s)])
                                table = np.zeros((e - s, ranges), np.int8)
                                for i in fine:
                                    table[i] = _coarse(packed[s + i], ranges)
                                cached[ranges] = table
                            apart = np.abs(cached[ranges][b] - cached[ranges][a])
                            apart = np.minimum(apart, 16 - apart).sum(1, dtype=np.int64)
                            forest.union(a, b[apart <= _differences(num, den, size[s + a], size[s + b])])
                    out += [(ids[s + a], ids[s + b]) for a, b in forest.links]
            if out:
                src, dst = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return run


class Trie:
    """Sets of ascending order keys as paths of LEVELS edges; equal beginnings share their nodes."""

    def __init__(self, grams: np.ndarray, at: np.ndarray):
        self.size = np.diff(at)
        n = len(self.size)
        count, label = np.zeros((n, LEVELS), np.int64), np.zeros((n, LEVELS), np.uint64)
        s = 0
        while s < n:  # a few sets at a time: blocks are large
            e = max(s + 1, int(np.searchsorted(at, at[s] + _PART, "right")) - 1)
            part = grams[at[s] : at[e]]
            cell = np.repeat(np.arange(e - s) * LEVELS, self.size[s:e]) + (part >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=(e - s) * LEVELS))))
            count[s:e], label[s:e] = np.diff(cuts).reshape(-1, LEVELS), tb.row_sums(tb.mix(part), cuts).reshape(-1, LEVELS)
            s = e
        self.bounds = np.concatenate(([0], np.cumsum(count.ravel())))
        self.grams, self.parent, self.edge, self.left = grams, [], [], []
        above = np.zeros(n, np.int64)
        done = np.zeros(n, np.int64)
        for d in range(LEVELS):
            done = done + count[:, d]
            key = tb.mix(label[:, d] + np.uint64(1) + tb.mix(above.astype(np.uint64) * np.uint64(3) + count[:, d].astype(np.uint64)))
            _, first, node = np.unique(key, return_index=True, return_inverse=True)
            self.parent.append(above[first])
            # the edge's n-grams, those of any set below it
            self.edge.append((self.bounds[first * LEVELS + d], self.bounds[first * LEVELS + d + 1]))
            small, rest = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
            np.minimum.at(small, node, self.size)
            np.maximum.at(rest, node, self.size - done)
            self.left.append((small, rest))
            above = node
        self.leaf_of = above

    def walk(self, probe: np.ndarray, wanted: np.ndarray, num: int, den: int) -> np.ndarray:
        """Of the members marked in wanted, those that link with the sorted probe."""
        n = len(probe)
        cuts = np.concatenate(([0], np.cumsum(np.bincount((probe >> np.uint64(64 - LEVEL_BITS)).astype(np.int64), minlength=LEVELS))))
        alive, overlap = np.ones(1, bool), np.zeros(1, np.int64)
        needed = self._needed(wanted)
        for d in range(LEVELS):
            node = np.flatnonzero(alive[self.parent[d]] & needed[d])
            s, e = self.edge[d][0][node], self.edge[d][1][node]
            length = e - s
            flat = np.repeat(s - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            part = probe[cuts[d] : cuts[d + 1]]
            if len(part) and len(flat):
                values = self.grams[flat]
                hit = part[np.minimum(np.searchsorted(part, values), len(part) - 1)] == values
                got = tb.row_sums(hit.astype(np.int64), np.concatenate(([0], np.cumsum(length))))
            else:
                got = np.zeros(len(node), np.int64)
            total = overlap[self.parent[d][node]] + got
            small, rest = self.left[d][0][node], self.left[d][1][node]
            can = total + np.minimum(n - cuts[d + 1], rest)
            ok = can * (num + den) >= num * (n + small)
            alive, overlap = np.zeros(len(self.parent[d]), bool), np.zeros(len(self.parent[d]), np.int64)
            alive[node[ok]], overlap[node[ok]] = True, total[ok]
            if not ok.any():
                return np.empty(0, np.int64)
        found = np.flatnonzero(wanted & alive[self.leaf_of])
        shared = overlap[self.leaf_of[found]]
        return found[den * shared >= num * (n + self.size[found] - shared)]

    def _needed(self, wanted: np.ndarray) -> list[np.ndarray]:
        """The nodes above the wanted members, by level."""
        mark = np.zeros(len(self.parent[-1]), bool)
        mark[self.leaf_of[wanted]] = True
        out = [mark]
        for d in range(LEVELS - 1, 0, -1):
            up = np.zeros(len(self.parent[d - 1]), bool)
            up[self.parent[d][out[0]]] = True
            out.insert(0, up)
        return out


def _linked(num: int, den: int):
    """Links of one candidate block (or pair of blocks), as a forest."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group.column("id").to_numpy()
        data, where = tb.string_bytes(group.column("grams").combine_chunks().cast(pa.large_binary()))
        grams, at = data[where[0] : where[-1]].view(np.uint64), (where - where[0]) // 8
        trie, forest = Trie(grams, at), Forest(len(ids))
        for a in range(len(ids) - 1):
            wanted = np.zeros(len(ids), bool)
            wanted[forest.apart(a)] = True
            if wanted.any():
                forest.union(a, trie.walk(grams[at[a] : at[a + 1]], wanted, num, den))
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"src": ids[links[:, 0]], "dst": ids[links[:, 1]]})

    return run


def _grams(k: int, order: Order):
    """(id, candidate, blocks, grams) of the rows whose set is the node's, grams in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, grams, at in _sets(batch, k):
                part = batch.take(pa.array(rows)).select(["id", "candidate", "blocks", "n", "h1", "h2"])
                h1, h2 = _hashes(grams, at)
                same = (part.column("h1").to_numpy() == h1) & (part.column("h2").to_numpy() == h2) & (part.column("n").to_numpy() == np.diff(at))
                keys = order.sorted_keys(grams, at)
                kept = np.flatnonzero(same)
                values = pa.array([keys[at[i] : at[i + 1]].tobytes() for i in kept], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(kept)).select(["id", "candidate", "blocks"]).columns, values], ["id", "candidate", "blocks", "grams"])

    return run


def _dealt(rows: DataFrame, by: str, node: str, most: int, size: str | None = None) -> DataFrame:
    """rows with i and j: groups of over most rows (or whose sum of size is above it) are cut into blocks, and each row goes to every pair of blocks that holds its own."""
    weight = F.count("*") if size is None else F.sum(size)
    large = rows.groupBy(by).agg(F.ceil(weight / most).cast("int").alias("blocks")).where("blocks > 1")
    cut = rows.join(large, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    paired = cut.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return paired.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _near(rows: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(src, dst) of a forest of candidate pairs; rows: token, id, component."""
    dealt = _dealt(rows, "token", "id", RUN_ROWS).select(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("token")).otherwise(F.xxhash64("token", "i", "j")).alias("token"), "id", "component")
    known = dealt.join(nodes.select("id", "n", "sketch"), "id")
    return known.repartition("token").sortWithinPartitions("token", "id").mapInArrow(_candidates(num, den), "src long, dst long")


def ngram_components(docs: DataFrame, k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), text_key.

    Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets of k-word shingles, with
    similarity = (num, den). A text of 1 to k-1 words has its whole sequence as its only shingle. text_key is xxhash64 of the text,
    which tells rows with the same doc_id apart.
    """
    num, den = similarity
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    run, schema = _profile(k)
    profile = materialise(docs.mapInArrow(run, schema))
    each = profile.where("token is null").drop("token", "sketch")
    classes = profile.where("token is null and n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    nodes = materialise(classes.withColumn("id", F.monotonically_increasing_id()))

    top = profile.where("token is not null").groupBy("token").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    order = Order(top.column("token").to_numpy().view(np.uint64), top.column("count").to_numpy())

    run, schema = _prefixes(k, num, den, order)
    prefix = docs.where("doc_id is not null").select("text").mapInArrow(run, schema)
    met = prefix.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_met(num, den), "token long, node long, place int")
    # nodes whose 64-bit hashes are equal by chance both come along
    shared = materialise(met.join(nodes.select(F.col("h1").alias("node"), "id"), "node").select("token", "id", "place"))
    near = materialise(_near(shared.where(F.col("place") < first_part(num, den)).select("token", "id", F.col("id").alias("component")), nodes, num, den))
    groups = components(near)
    grouped = shared.select("token", "id").join(groups, "id", "left").select("token", "id", F.coalesce("component", "id").alias("component"))
    between = grouped.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    more = materialise(_near(grouped.join(between, "token", "left_semi"), nodes, num, den))
    if more.limit(1).count():
        groups = components(near.union(more))

    sized = groups.join(nodes.select("id", "n", "h1", "h2", "doc_id"), "id").withColumnRenamed("component", "candidate")
    blocks = sized.groupBy("candidate").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"))
    member = sized.join(blocks, "candidate")
    # one row of each node is enough
    sets = docs.select("doc_id", "text").join(member, "doc_id").mapInArrow(_grams(k, order), "id long, candidate long, blocks int, grams binary")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = sets.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("candidate", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "grams")
    # a group of one block is done in one task; of more, each pair of blocks
    linked = pairs.groupBy("candidate", "i", "j").applyInArrow(_linked(num, den), "src long, dst long")
    final = components(linked)

    named = nodes.select("id", "doc_id", "h1", "h2", "n").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = named.join(least, "component").select("h1", "h2", "n", "component_id")
    out = each.join(known, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "text_key")
