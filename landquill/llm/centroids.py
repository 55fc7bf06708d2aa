"""Centroid clustering by a bisector tournament: exact k-means over integer vectors, with floor means.

For centroids a < b the bisecting plane is an integer normal 2 (b - a) and an integer threshold |b|^2 - |a|^2. A vector lies nearer to b
if its product with the normal is above the threshold; below it, and on the plane itself, a wins, so that ties go to the smaller number.
The planes of all pairs are computed once a round. Each vector plays a knockout over the centroids, k - 1 sign tests, and only the winner's distance is
computed. "Nearer, then smaller number" is a total order, so that any bracket has the same winner.

All sums are whole numbers: doubles while they hold every intermediate value exactly, else 64-bit, else Python integers. What reaches the
driver is one sum of each component for each centroid, whatever the size of the table; the tasks send partial sums, so that a large
cluster is no large group.

Vectors that are null, have another length, or hold null or non-finite components are left out, as are those with a component that needs
more than 60 bits after scaling. Rows that share a vec_id are a vector each. Rows without a vec_id are clustered but are no first
centroid. With fewer vectors than centroids, each vector is one. Distances and inertias that do not fit a long are null. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

LARGEST = float(1 << 60)
_BLOCK = 1024
_LONG = (1 << 63) - 1


def _kept(column: pa.Array, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scaled floors (whole doubles) of the vectors that take part."""
    offsets = column.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(offsets) == d) & np.asarray(column.is_valid()))
    values = column.values.to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * values[offsets[rows][:, None] + np.arange(d)].astype(np.float64))
        fine = (np.abs(x) < LARGEST).all(1)
    return rows[fine], x[fine]


def _kind(bound: int, d: int) -> type:
    """The cheapest number type that holds all products and sums of d components of up to bound exactly."""
    worst = 4 * d * bound * bound
    return np.float64 if worst < 1 << 52 else np.int64 if worst < 1 << 62 else object


class Bisectors:
    """The planes between all pairs of centroids, and the knockout over them."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.bound = max((abs(v) for c in centroids for v in c), default=0)
        self.planes: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _planes(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.planes:
            c = np.array(self.centroids, dtype=kind)
            square = (c * c).sum(1)
            self.planes[kind] = (c, 2 * (c[None] - c[:, None]), square[None] - square[:, None])
        return self.planes[kind]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid's number and the squared distance to it, for whole doubles x."""
        d = x.shape[1]
        kind = _kind(max(self.bound, int(np.abs(x).max(initial=0))), d)
        c, normal, limit = self._planes(kind)
        if kind is object:
            x = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
        else:
            x = x.astype(kind)
        winner = np.empty(len(x), np.int64)
        for s in range(0, len(x), _BLOCK):
            part = x[s : s + _BLOCK]
            field = np.broadcast_to(np.arange(len(c)), (len(part), len(c)))
            while field.shape[1] > 1:
                paired = field.shape[1] // 2 * 2
                a, b = field[:, 0:paired:2], field[:, 1:paired:2]
                if field.shape[1] == len(c):  # all vectors play the same first pairs
                    side = part @ normal[a[0], b[0]].T - limit[a[0], b[0]]
                elif kind is object:
                    side = (part[:, None, :] * normal[a, b]).sum(2) - limit[a, b]
                else:
                    side = np.matmul(normal[a, b], part[:, :, None])[:, :, 0] - limit[a, b]
                field = np.concatenate((np.where(side > 0, b, a), field[:, paired:]), 1)
            winner[s : s + _BLOCK] = field[:, 0]
        gap = x - c[winner]
        return winner, (gap * gap).sum(1)


def _arrow_batches(batches: Iterator[pa.RecordBatch], d: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            rows, x = _kept(batch.column("embedding"), d, scale)
            if len(rows):
                yield batch, rows, x


def _first(k: int, d: int, scale: int, seed: str):
    """The k vectors of a task with the smallest hashes: (hash, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for batch, rows, x in _arrow_batches(batches, d, scale):
            ids = batch.column("vec_id").to_pylist()
            hashed = [(hashlib.sha256(f"{seed}:{ids[r]}".encode()).hexdigest(), i) for i, r in enumerate(rows) if ids[r] is not None]
            cut = max(heapq.nsmallest(k, hashed), default=("", 0))[0]
            best = heapq.nsmallest(k, best + [(h, [int(v) for v in x[i]]) for h, i in hashed if h <= cut])
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["hash", "vector"])

    return run


def _sums(planes: Bisectors, k: int, d: int, scale: int):
    """Partial sums of a task: (cluster, n, high, low); a sum is high * 2**32 + low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, d), object), np.zeros(k, np.int64)
        for _, _, x in _arrow_batches(batches, d, scale):
            winner, _ = planes.nearest(x)
            n += np.bincount(winner, minlength=k)
            small = np.abs(x).max(initial=0) * len(x) < 1 << 52
            for c in np.unique(winner):
                mine = x[winner == c]
                total[c] += [int(v) for v in mine.sum(0)] if small else [sum(int(v) for v in column) for column in mine.T]
        held = np.flatnonzero(n)
        high, low = ([[f(int(v)) for v in total[c]] for c in held] for f in (lambda v: v >> 32, lambda v: v & 0xFFFFFFFF))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))], ["cluster", "n", "high", "low"])

    return run


def _assigned(planes: Bisectors, d: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _arrow_batches(batches, d, scale):
            winner, far = planes.nearest(x)
            distance = pa.array([int(v) if v <= _LONG else None for v in far], pa.int64()) if far.dtype == object else pa.array(far.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(winner.astype(np.int32)), distance], ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(table: DataFrame, k: int = 40, d: int = 64, scale: int = 256, rounds: int = 5, seed: str = "2") -> tuple[DataFrame, DataFrame]:
    """Clusters of table (vec_id, embedding): the members (vec_id, cluster, distance) and the centroids (cluster, centroid, n, inertia).

    Components become floor(scale * x). The first centroids are the k vectors with the smallest SHA-256 of '<seed>:<vec_id>', in that order (equal
    hashes by their components). Each round assigns all vectors and moves every non-empty centroid to its members' floor means; then all are
    assigned once more. n and inertia (the sum of squared distances) are those of the last assignment.
    """
    spark = table.sparkSession
    kind = table.schema["embedding"].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if plain else F.col("embedding").cast("array<double>").alias("embedding"))
    first = vectors.mapInArrow(_first(k, d, scale, seed), "hash string, vector array<long>").orderBy("hash", "vector").limit(k)
    centroids = [list(r["vector"]) for r in first.collect()]  # k rows
    for _ in range(rounds if centroids else 0):
        parts = vectors.mapInArrow(_sums(Bisectors(centroids), len(centroids), d, scale), "cluster long, n long, high array<long>, low array<long>")
        each = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
        moved = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
        for r in moved.collect():  # k * d rows at most
            centroids[r["cluster"]][r["at"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    out = "vec_id long, cluster int, distance long"
    members = materialise(vectors.mapInArrow(_assigned(Bisectors(centroids), d, scale), out)) if centroids else spark.createDataFrame([], out)
    long_sum = F.expr("try_cast(sum(cast(distance as decimal(38, 0))) as bigint)")
    counted = members.groupBy("cluster").agg(F.count("*").alias("n"), long_sum.alias("inertia"), F.count_if(F.col("distance").isNull()).alias("lost")).withColumn("inertia", F.when(F.col("lost") == 0, F.col("inertia"))).drop("lost")
    places = spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    return members, places.join(counted, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def oracle_sql(k: int = 40, d: int = 64, scale: int = 256, rounds: int = 5, seed: str = "2") -> str:
    """DuckDB SQL for the members with their digests, by plain distances to all centroids."""
    parts = [
        f"""w as (select vec_id, [floor({scale} * x::double) for x in embedding] as f from embeddings
  where len(embedding) = {d} and len([x for x in embedding if x is not null and isfinite(x)]) = {d}),
v as (select row_number() over () as r, vec_id, [x::bigint for x in f] as v from w),
c0 as (select row_number() over (order by sha256('{seed}:' || vec_id), v) - 1 as c, v as p from v where vec_id is not null qualify c < {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""p{i} as (select r, c, list_sum([(v[i] - p[i]) * (v[i] - p[i]) for i in range(1, {d + 1})])::bigint as d from v cross join c{i}),
a{i} as (select r, arg_min(c, d * 1000 + c) as c, min(d) as d from p{i} group by r)""")
        if i < rounds:
            parts.append(f"""u{i} as (select a.c, unnest(range(1, {d + 1})) as i, unnest(v.v) as x from a{i} a join v using (r)),
s{i} as (select c, i, sum(x)::hugeint as s, count(*)::hugeint as n from u{i} group by c, i),
m{i} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as p from s{i} group by c),
c{i + 1} as (select c, coalesce(m.p, o.p) as p from c{i} o left join m{i} m using (c))""")
    last = f"""select v.vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,
  sha256(array_to_string(p, ',')) as centroid_sha256 from a{rounds} a join v using (r) join c{rounds} using (c)"""
    return "with " + ",\n".join(parts) + "\n" + last
