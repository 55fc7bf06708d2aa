"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The raw model counts the hashed words and word pairs of all documents; the target model those of a bounded sample of target
documents (``SAMPLE`` ids, by hash order). A document's log weight is the log ratio of its probabilities under the two models, the sum
of the log ratios of its n-grams. Gumbel noise from a hash of seed and doc_id is added, and the k largest sums are kept, ties to
the smaller doc_id: a sample without replacement in proportion to the weights. k is the number of documents whose log weight
is at least the ``loss`` quantile of the target sample.

Tasks send one row per bucket, the driver gets the two models (``BUCKETS`` numbers each) and counts, never documents. Texts
that are null or have no words have no log weight and are rejected; copies are weighed alike, and repeated rows (same doc_id and text)
are kept or rejected together, so that more than k rows stay if the last place is repeated. Without any
target document nothing can be compared and every document with words is kept. Further columns pass through, but for
those with the name of a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb
from .shared import materialise

BITS = 16
BUCKETS = 1 << BITS
SAMPLE = 5000
LOSS = 0.002


def _grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, buckets of words, offsets, buckets of pairs, offsets) by block."""
    for first, last, data, where in tb.blocks(column):
        word, at = tb.words(data, where)
        pair, pair_at = tb.shingles(word, at, 2)
        yield first, last, (word >> np.uint64(64 - BITS)).astype(np.int64), at, (pair >> np.uint64(64 - BITS)).astype(np.int64), pair_at


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of the hashed words and word pairs over all rows of texts (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, word, _, pair, _ in _grams(batch.column("text")):
                total += np.bincount(word, minlength=BUCKETS) + np.bincount(pair, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


@dataclass
class Model:
    ratio: np.ndarray  # log ratio of target to raw, by bucket
    fitted: bool


def fit(docs: DataFrame, target: DataFrame) -> Model:
    """target: doc_id of the bounded sample of target documents."""
    raw = bucket_counts(docs)
    want = bucket_counts(docs.join(F.broadcast(target), "doc_id", "left_semi"))
    ratio = np.log((want + 1) / (want.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return Model(ratio, bool(want.sum()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_ngrams and log_weight (null without n-grams)."""
    ratio = model.ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, last, word, at, pair, pair_at in _grams(batch.column("text")):
                total[first:last] = tb.row_sums(ratio[word], at) + tb.row_sums(ratio[pair], pair_at)
                count[first:last] = np.diff(at) + np.diff(pair_at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(count), pa.array(total, mask=count == 0)], [*batch.schema.names, "n_ngrams", "log_weight"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def gumbel(doc_id: Column, seed: int = 0) -> Column:
    """Gumbel noise from a hash of doc_id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"quality-{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


CELLS, FEW = 2048, 1000


def _kth(rows: DataFrame, column: str, k: int) -> tuple[float | int, int]:
    """The k-th smallest value of a column without nulls, and how many rows are smaller; by counting in ever finer cells."""
    whole = dict(rows.dtypes)[column] == "bigint"
    left = k
    while True:
        ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n")).first()
        lo, hi = ends["lo"], ends["hi"]
        if lo == hi:
            return lo, k - left
        if ends["n"] <= FEW:
            values = sorted(r[0] for r in rows.select(column).collect())
            return values[left - 1], k - left + sum(v < values[left - 1] for v in values)
        if whole:
            cell = F.expr(f"({column} - {lo}L) div {(hi - lo) // CELLS + 1}L")
        else:
            step = (hi - lo) / CELLS
            # neighbouring doubles: the lower one is a cell of its own
            cell = F.floor((F.col(column) - F.lit(lo)) / F.lit(step)).cast("long") if lo + step > lo else (F.col(column) > F.lit(lo)).cast("long")
        for r in rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect():
            if r["n"] >= left:
                break
            left -= r["n"]
        rows = rows.where(cell == r["cell"])


def kth_largest(rows: DataFrame, k: int) -> tuple[float, int | None]:
    """(key, doc_id) of the k-th row (doc_id, key) by key, largest first, then doc_id, nulls last."""
    low, above = _kth(rows.select((-F.col("key")).alias("key")), "key", k)
    tied = rows.where(F.col("key") == F.lit(-low)).select("doc_id")
    named = tied.where("doc_id is not null")
    if k - above > named.count():
        return -low, None
    return -low, _kth(named, "doc_id", k - above)[0]


def resample(docs: DataFrame, target: DataFrame, loss: float = LOSS, seed: int = 0, sample: int = SAMPLE) -> DataFrame:
    """docs with n_ngrams, log_weight, gumbel_key and kept.

    docs: doc_id, text and any others. target: doc_id of documents known to be good; ``sample`` of them are used.
    """
    docs = docs.drop("n_ngrams", "log_weight", "gumbel_key", "kept")
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    ids = materialise(ids)
    model = fit(docs, ids)
    out = scored(docs, model).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    if not model.fitted:
        return out.withColumn("kept", F.col("log_weight").isNotNull())
    small = materialise(out.select(F.col("doc_id").cast("long").alias("doc_id"), "log_weight", F.col("gumbel_key").alias("key")).where("log_weight is not null"))
    edge = small.join(F.broadcast(ids), "doc_id", "left_semi").agg(F.percentile("log_weight", loss).alias("edge")).first()["edge"]
    k = small.where(F.col("log_weight") >= F.lit(edge)).count()
    key, last = kth_largest(small, k)
    tie = F.lit(True) if last is None else F.coalesce(F.col("doc_id") <= F.lit(last), F.lit(False))
    return out.withColumn("kept", F.coalesce((F.col("gumbel_key") > F.lit(key)) | ((F.col("gumbel_key") == F.lit(key)) & tie), F.lit(False)))
