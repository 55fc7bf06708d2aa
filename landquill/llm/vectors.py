"""Embedding search and near-duplicates: p-stable and cross-polytope hashing with multiprobe buckets.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part. Vectors of different lengths are
never compared. Equal vectors (and labels, for links) are one class, which is hashed and compared once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .ngram_join import _runs
from .shared import components, materialise

# nearest neighbours, the indexes to choose from: hash functions a table, tables, buckets probed a table, cell width (for vectors of length 1 at most). All
# send a query to as many buckets, so that the choice does not change how copies grow with the queries
INDEXES = tuple((m, 4, 20, w) for m in (3, 4, 5, 6, 7, 8, 10, 12) for w in (2.4, 1.7, 1.2, 0.8))
# an index is chosen by the exact neighbours of so many queries, and the part of so many vectors that it makes them meet
TUNING_QUERIES, TUNING_VECTORS, RECALL = 40, 1000, 0.95
# near-duplicates: cross-polytope hashes a table, tables
POLYTOPES, ROTATIONS, LINK_TABLES = 3, 3, 8
BLOCK_ROWS = 4096  # rows of a bucket that meet in one task; larger buckets are cut
_CHUNK = 512


def usable(table: DataFrame, *more: str) -> DataFrame:
    """vec_id, embedding (doubles), and more, of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.where("vec_id is not null").where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), *more)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]


def _keys(parts: np.ndarray, table: int, d: int) -> np.ndarray:
    """64-bit bucket keys of integer cells (last axis)."""
    h = np.full(parts.shape[:-1], (table + 1) * 1_000_003 + d, np.uint64)
    for j in range(parts.shape[-1]):
        h = tb.mix(h * np.uint64(31) + parts[..., j].astype(np.int64).view(np.uint64))
    return h


class StableHash:
    """p-stable hashing of vectors scaled into the unit ball; an extra coordinate turns inner product into distance.

    index: hash functions a table, tables, buckets probed a table, cell width. With more functions buckets are smaller, and more of them for the same vectors.
    """

    def __init__(self, scale: float, index: tuple[int, int, int, float]):
        self.scale, (self.hashes, self.tables, self.probed, self.cell) = scale, index
        # all moves by one cell for few functions; for many, those in up to three of them, or two
        few = self.hashes <= 5
        self.moves = np.array([m for m in itertools.product((-1, 0, 1), repeat=self.hashes)]) if few else self._sparse_moves()

    def _sparse_moves(self) -> np.ndarray:
        out = [np.zeros(self.hashes, np.int64)]
        for n in (1, 2, 3) if self.hashes <= 12 else (1, 2):
            for where in itertools.combinations(range(self.hashes), n):
                for by in itertools.product((-1, 1), repeat=n):
                    out.append(np.zeros(self.hashes, np.int64))
                    out[-1][list(where)] = by
        return np.array(out)

    def _places(self, x: np.ndarray, t: int, query: bool) -> np.ndarray:
        d = x.shape[1]
        rng = np.random.default_rng((t, d, 11))
        norm = np.sqrt((x * x).sum(1))
        y = x / norm[:, None] if query else x / self.scale
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (norm / self.scale) ** 2))
        return (np.column_stack((y, lift)) @ rng.normal(size=(d + 1, self.hashes)) + rng.uniform(0, self.cell, self.hashes)) / self.cell

    def bucket(self, x: np.ndarray, t: int) -> np.ndarray:
        return _keys(np.floor(self._places(x, t, False)).astype(np.int64), t, x.shape[1])

    def probes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Keys of the perturbed buckets that most likely hold a near vector, best first."""
        place = self._places(x, t, True)
        cell = np.floor(place).astype(np.int64)
        gap = place - cell
        cost = (gap**2) @ (self.moves < 0).T + ((1 - gap) ** 2) @ (self.moves > 0).T
        best = np.argsort(cost, 1, kind="stable")[:, : self.probed]
        return _keys(cell[:, None, :] + self.moves[best], t, x.shape[1])

    def meet(self, queries: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether each query meets each row of x in some table."""
        out = np.zeros((len(queries), len(x)), bool)
        for t in range(self.tables):
            home, probes = self.bucket(x, t), self.probes(queries, t)
            for k in range(len(queries)):
                out[k] |= np.isin(home, probes[k])
        return out


def choose_index(scale: float, queries: np.ndarray, near: np.ndarray, near_of: np.ndarray, others: np.ndarray) -> tuple[int, int, int, float]:
    """The index of least work, of those that meet RECALL of the near rows (row i belongs to query near_of[i]); the one that meets most if none does.

    Work is the part of others that a query meets.
    """
    best, most = None, None
    for index in INDEXES:
        hashing = StableHash(scale, index)
        recall = float(hashing.meet(queries, near)[near_of, np.arange(len(near))].mean())
        work = float(hashing.meet(queries, others).mean())
        most = max(most or (recall, -work, index), (recall, -work, index))
        if recall >= RECALL and (best is None or work < best[0]):
            best = work, index
    return best[1] if best else most[2]


def _bucketed(scale: float, query: bool, index: tuple[int, int, int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = StableHash(scale, index)
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, x in _matrices(batch.column("embedding")):
                for t in range(hashing.tables):
                    keys = hashing.probes(x, t) if query else hashing.bucket(x, t)[:, None]
                    part = batch.take(pa.array(np.repeat(rows, keys.shape[1])))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tb.signed(keys.ravel()))], [*part.schema.names, "bucket"])

    return run


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1] if len(a) else 0):
        out += a[:, j] * b[:, j]
    return out


def _best(k: int):
    """The k best classes of each query among a bucket's, by inner product, then smallest id.

    A matrix product finds the best; its last bits depend on the shapes of blocks, so that what is near the k-th is scored again, in one
    order of addition.
    """

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and items.num_rows:
            ids, names = items.column("id").to_numpy(), queries.column("query").to_numpy()
            q = dict((rows_x[1].shape[1], rows_x) for rows_x in _matrices(queries.column("embedding").combine_chunks()))
            for rows, x in _matrices(items.column("embedding").combine_chunks()):
                if x.shape[1] in q:
                    q_rows, y = q[x.shape[1]]
                    order = np.argsort(ids[rows], kind="stable")
                    own, x = ids[rows][order], x[order]
                    for s in range(0, len(q_rows), _CHUNK):
                        score = y[s : s + _CHUNK] @ x.T
                        n = min(k, len(own))
                        if n < len(own):
                            edge = -np.partition(-score, n - 1, 1)[:, n - 1 : n]
                            slack = 1e-12 * np.sqrt((y[s : s + _CHUNK] ** 2).sum(1, keepdims=True) * (x * x).sum(1).max())
                            row, col = np.nonzero(score >= edge - slack)
                        else:
                            row, col = (z.ravel() for z in np.indices(score.shape))
                        value = inner(y[s + row], x[col])
                        by = np.lexsort((own[col], -value, row))
                        row, col, value = row[by], col[by], value[by]
                        first = np.searchsorted(row, row)
                        keep = np.arange(len(row)) - first < n
                        out.append((names[q_rows[s + row[keep]]], own[col[keep]], value[keep]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table({"query": cols[0], "id": cols[1], "score": cols[2]})

    return run


def _cut(items: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to (bucket, i, j): the items and the queries of a bucket are split into blocks, and each block of items meets each of queries."""
    parts = [df.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(n)) for df, n in ((items, "items"), (queries, "queries"))]
    blocks = parts[0].join(parts[1], "bucket")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = items.join(blocks, "bucket").withColumn("i", own("id", "items")).withColumn("j", every("queries"))
    asked = queries.join(blocks, "bucket").withColumn("j", own("query", "queries")).withColumn("i", every("items"))
    return dealt.select("id", "embedding", "bucket", "i", "j"), asked.select("query", "embedding", "bucket", "i", "j")


def _search(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    items, queries = _cut(items, queries)
    keys = ("bucket", "i", "j")
    found = queries.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInArrow(_best(k), "query long, id long, score double")
    # the tables' candidates together: one score for each pair, then the best
    return found.groupBy("query", "id").agg(F.max("score").alias("score"))


def tuned_index(classes: DataFrame, asked: DataFrame, scale: float, k: int) -> tuple[int, int, int, float]:
    """An index (see choose_index) for the vectors of classes (id, embedding), tuned on TUNING_QUERIES of asked (query, asked) and their exact k nearest.

    Queries and vectors are drawn by hash, of the most common length of vectors. What reaches the driver is bounded by the constants.
    """
    d = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if d is None:
        return INDEXES[0]
    mine = classes.where(F.size("embedding") == d["d"]).select("id", "embedding")
    drawn = materialise(asked.where(F.size("asked") == d["d"]).select("query", F.col("asked").alias("embedding")).orderBy(F.xxhash64("query"), "query").limit(TUNING_QUERIES))
    one = F.lit(0).cast("long").alias("bucket")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    pairs = _search(mine.select("*", one), drawn.select("*", one), k + 1).withColumn("n", F.row_number().over(ranked)).where((F.col("n") <= k + 1) & (F.col("query") != F.col("id")))
    found = pairs.join(mine, "id").select("query", "embedding").collect()
    queries = drawn.orderBy("query").collect()
    others = mine.orderBy(F.xxhash64("id"), "id").limit(TUNING_VECTORS).collect()
    if not found:
        return INDEXES[0]
    place = {r["query"]: i for i, r in enumerate(queries)}
    matrix = lambda rows: np.array([r["embedding"] for r in rows], float)
    return choose_index(scale, matrix(queries), matrix(found), np.array([place[r["query"]] for r in found]), matrix(others))


def nearest(table: DataFrame, k: int = 20, every: int = 20, index: tuple[int, int, int, float] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product for each vector whose id is divisible by every.

    Ties go to the smaller vec_id. A query for which the probed buckets hold fewer than k others is searched again against
    all vectors, in blocks, so that it gets k where there are k. Rows that share a vec_id are one vector each; a query's own
    id is never its result. index: one like INDEXES; else it is tuned on a bounded sample (see tuned_index) to the
    recall that RECALL names, so that a query meets a smaller part of the vectors where near ones are nearer than the rest.
    """
    rows = usable(table)
    each = Window.partitionBy("embedding").orderBy("vec_id")
    # of equal vectors the k + 1 smallest ids can be results; all of them can be queries. Spark cuts groups to that number before it deals them
    few = rows.distinct().withColumn("n", F.row_number().over(each)).where(F.col("n") <= k + 1)
    classes = materialise(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.element_at("ids", 1)))
    asked = materialise(rows.where(F.col("vec_id") % every == 0).groupBy("embedding").agg(F.min("vec_id").alias("query")).select("query", F.col("embedding").alias("asked")))
    scale = classes.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if scale is None:
        scale = 1.0
    index = index or tuned_index(classes, asked, scale, k)
    items = classes.select("id", "embedding").mapInArrow(_bucketed(scale, False, index), "id long, embedding array<double>, bucket long")
    probes = asked.select("query", F.col("asked").alias("embedding")).mapInArrow(_bucketed(scale, True, index), "query long, embedding array<double>, bucket long")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1).drop("n")

    found = materialise(top(_search(items, probes, k + 1)))
    sized = found.join(classes.select("id", F.size("ids").alias("held")), "id").groupBy("query").agg(F.sum("held").alias("held"))
    short = asked.join(sized, "query", "left").where(F.coalesce("held", F.lit(0)) < k + 1).select("query", F.col("asked").alias("embedding"))
    again = top(_search(classes.select("id", "embedding", F.lit(0).cast("long").alias("bucket")), short.withColumn("bucket", F.lit(0).cast("long")), k + 1))
    best = found.join(short.select("query"), "query", "left_anti").unionByName(again)
    named = rows.where(F.col("vec_id") % every == 0).select("vec_id", F.col("embedding").alias("asked")).distinct().join(asked, "asked").select("query", F.col("vec_id").alias("query_id"))
    pairs = named.join(best, "query").join(classes.select("id", F.explode("ids").alias("vec_id")), "id").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.select("query_id", "vec_id", "score").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, size)
        step *= 2
    return x


class CrossPolytope:
    """Codes of the nearest and second nearest axis after pseudo-random rotations, combined over POLYTOPES hashes."""

    def __init__(self, d: int):
        self.size = 1 << max(1, (d - 1).bit_length())
        rng = np.random.default_rng((d, 17))
        self.signs = rng.choice((-1.0, 1.0), (LINK_TABLES, POLYTOPES, ROTATIONS, self.size))
        self.choices = np.array(list(itertools.product((0, 1), repeat=POLYTOPES)))  # first: all nearest

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(row, table, choice) -> code; choice 0 is the home bucket, the others are probes."""
        base = np.zeros((len(x), self.size))
        base[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1))[:, None]
        out = np.zeros((len(x), LINK_TABLES, len(self.choices)), np.int64)
        for t in range(LINK_TABLES):
            for p in range(POLYTOPES):
                y = base
                for r in range(ROTATIONS):
                    y = hadamard(y * self.signs[t, p, r]) / np.sqrt(self.size)
                two = np.argsort(-np.abs(y), 1, kind="stable")[:, :2]
                axis = two * 2 + (np.take_along_axis(y, two, 1) > 0)
                out[:, t] = out[:, t] * (2 * self.size) + axis[:, self.choices[:, p]]
        return out


_CODES = (LINK_TABLES, 1 << POLYTOPES)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds codes, the cross-polytope codes of each vector by table and choice."""
    known: dict[int, CrossPolytope] = {}
    for batch in batches:
        if batch.num_rows:
            for rows, x in _matrices(batch.column("embedding")):
                hashing = known.setdefault(x.shape[1], CrossPolytope(x.shape[1]))
                values = pa.array([c.tobytes() for c in hashing.codes(x)], pa.binary())
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, values], [*part.schema.names, "codes"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, id, home, t): one for each table's home bucket and each of its probes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, label, d = (batch.column(c).to_numpy() for c in ("id", "h", "d"))
        code = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int64).reshape(-1, *_CODES)
        for t in range(LINK_TABLES):
            token = tb.mix(_keys(code[:, t, :, None], t, 0) ^ tb.mix(label.view(np.uint64) + d.astype(np.uint64))[:, None])
            n = token.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(tb.signed(token.ravel())), pa.array(np.repeat(ids, n)), pa.array(np.tile(np.arange(n) == 0, len(ids))), pa.array(np.full(n * len(ids), t, np.int8))], ["token", "id", "home", "t"])


def _links(least: float):
    """Partial link counts (id, n) and a forest of links (src, dst) of one bucket, or pair of blocks of it.

    A pair is counted only at the first place where it meets: the smallest table, and in a table the smaller code.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            token = part.column("token").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            columns = {c: part.column(c).to_numpy() for c in ("id", "own", "i", "j", "home", "many", "t")}
            columns["label"] = pa.concat_arrays(part.column("label").chunks).dictionary_encode().indices.to_numpy()
            code = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.int64).reshape(-1, *_CODES)
            vectors = list(_matrices(part.column("embedding").combine_chunks()))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                rows = [(w[(w >= s) & (w < e)] - s, x[(w >= s) & (w < e)]) for w, x in vectors] if len(vectors) > 1 else [(np.arange(e - s), vectors[0][1][s:e])]
                out = one({c: v[s:e] for c, v in columns.items()}, code[s:e], rows)
                if out is not None:
                    yield out

    def one(columns: dict[str, np.ndarray], code: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
        ids, own, home, many, labels = (columns[c] for c in ("id", "own", "home", "many", "label"))
        i, j, t = int(columns["i"][0]), int(columns["j"][0]), int(columns["t"][0])
        counts, edges = np.zeros(len(ids), np.int64), []
        root = np.arange(len(ids))
        for rows, x in parts:
            if len(rows) < 2:
                continue
            unit = x / np.sqrt((x * x).sum(1))[:, None]
            for s in range(0, len(rows), _CHUNK):
                a = rows[s : s + _CHUNK]
                a = a[(own[a] == i)]
                b = rows[own[rows] == j]
                if not len(a) or not len(b):
                    continue
                ua, ub = unit[np.searchsorted(rows, a)], unit[np.searchsorted(rows, b)]
                r, c = np.nonzero(ua @ ub.T >= least)
                p, q = a[r], b[c]
                ok = (labels[p] == labels[q]) & ((ids[p] < ids[q]) if i == j else (ids[p] != ids[q]))
                p, q = p[ok], q[ok]
                for k in range(0, len(p), 100_000):
                    pp, qq = p[k : k + 100_000], q[k : k + 100_000]
                    here = home[pp] | home[qq]
                    cp, cq = code[pp], code[qq]
                    for e in range(t):
                        here &= ~((cq[:, e] == cp[:, e, :1]).any(1) | (cp[:, e] == cq[:, e, :1]).any(1))
                    # within the table: at p's home if q comes there, and at q's if p does; the smaller code counts
                    at_p, at_q = (cq[:, t] == cp[:, t, :1]).any(1), (cp[:, t] == cq[:, t, :1]).any(1)
                    both = at_p & at_q & (cp[:, t, 0] != cq[:, t, 0])
                    small = np.where(cp[:, t, 0] < cq[:, t, 0], home[pp], home[qq])
                    here &= ~both | small
                    np.add.at(counts, pp[here], many[qq[here]])
                    np.add.at(counts, qq[here], many[pp[here]])
                    met = home[pp] | home[qq]
                    pp, qq = pp[met], qq[met]
                    while len(pp):
                        x_, y_ = root[pp], root[qq]
                        apart = x_ != y_
                        if not apart.any():
                            break
                        pp, qq = pp[apart], qq[apart]
                        high, low = np.maximum(x_, y_)[apart], np.minimum(x_, y_)[apart]
                        # each root hooks onto one smaller neighbour
                        to = np.arange(len(root))
                        np.minimum.at(to, high, low)
                        moved = np.flatnonzero(to != np.arange(len(root)))
                        edges.append(np.stack((ids[to[moved]], ids[moved])))
                        for _ in range(64):
                            nxt = to[to]
                            if (nxt == to).all():
                                break
                            to = nxt
                        root = to[root]
        hit = np.flatnonzero(counts)
        edge = np.concatenate(edges, 1) if edges else np.empty((2, 0), np.int64)
        if not len(hit) and not edge.shape[1]:
            return None
        known = np.arange(len(hit) + edge.shape[1]) < len(hit)
        src, dst, n = np.concatenate((ids[hit], edge[0])), np.concatenate((ids[hit], edge[1])), np.concatenate((counts[hit], np.zeros(edge.shape[1], np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst, mask=known), pa.array(n, mask=~known)], ["src", "dst", "n"])

    return run


def linked_vectors(table: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors of equal label whose cosine is at least ``least``.

    One row per row of table (vec_id, embedding, label). Vectors without a label link with nothing. A null vec_id links with
    nothing and is kept with a null component. Rows that share a vec_id count as one vector of that id each.
    """
    rows = usable(table.where("label is not null"), "label")
    classes = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("many")).withColumns({"h": F.xxhash64("label"), "d": F.size("embedding").cast("long")})
    classes = materialise(classes.mapInArrow(_coded, T.StructType([*classes.schema.fields, T.StructField("codes", T.BinaryType())])))
    coded = classes.select("id", "h", "d", "codes").mapInArrow(_tokens, "token long, id long, home boolean, t byte")
    # only buckets that somebody is at home in and somebody else visits
    counted = materialise(coded)
    size = counted.groupBy("token").agg(F.count("*").alias("n"), F.bool_or("home").alias("lived")).where("n > 1 and lived").select("token", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    met = counted.join(size, "token").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = met.select(F.xxhash64("token", i, j).alias("token"), i.alias("i"), j.alias("j"), "own", "id", "home", "t")
    full = dealt.join(classes.select("id", "embedding", "codes", "label", "many"), "id")
    out = materialise(full.repartition("token").sortWithinPartitions("token", "id").mapInArrow(_links(least), "src long, dst long, n long"))
    links = out.where("n is not null").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n"))
    groups = components(out.where("dst is not null").select("src", "dst"))
    member = rows.distinct().join(classes, ["label", "embedding"]).join(links, "id", "left").join(groups, "id", "left")
    known = member.groupBy("vec_id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.min(F.coalesce("component", "id")).alias("c"))
    result = table.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, "vec_id", "left")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), F.coalesce(F.col("c") == F.col("vec_id"), F.lit(True)).alias("kept"))
