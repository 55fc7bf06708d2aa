"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are the runs of 3 and of 4 bytes of the lower-cased text that hold no white space but at their ends. Each is hashed
to one of ``BUCKETS`` embeddings; their mean goes through a linear softmax. Training takes a bounded sample (by hash of doc_id): about
``DOCS_PER_LANGUAGE`` documents of each language, fewer where they would be more than ``SAMPLE`` in all, but about ``LEAST`` of each at
least, and from each document ``WINDOWS`` windows of ``WINDOW`` subwords. Every language takes part, however many there are. One sampled
document in five is held back from training; on those the softmax is calibrated by a temperature, and the rejection threshold is
set so that ``LOSS`` of right answers fall below it.

With few languages prediction folds the embeddings and the softmax weights into one table of scores by bucket and language; with more than
``WIDTH`` it sums embeddings. A whole text is a few gathers and sums, in blocks of bounded size. Null texts and texts without a letter
are 'und' with score 0. Texts too short for a subword get the most frequent language's prior. Without training rows everything is
'und'. A null doc_id is not held out and takes no part in training; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textblocks as tb

BITS, WIDTH = 16, 16
BUCKETS = 1 << BITS
DOCS_PER_LANGUAGE, SAMPLE, LEAST, WINDOWS, WINDOW = 400, 12_000, 8, 8, 128
EPOCHS, BATCH, RATE, LOSS = 4, 64, 8.0, 0.005
FEW_LANGUAGES = 10_000
_ORDERS = (3, 4)


def subwords(data: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(n, bucket, valid) of the runs of n bytes from each place on."""
    value, space = tb._BYTE_VALUE[data], tb.DELIMITER[data]
    out = []
    for n in _ORDERS:
        size = max(0, len(data) - n + 1)
        code, valid = np.full(size, n, np.uint64), np.ones(size, bool)
        for j in range(n):
            code += value[j : j + size] * tb._PLACE[j]
            if 0 < j < n - 1:
                valid &= ~space[j : j + size]
        out.append((n, ((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64), valid))
    return out


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: doc_id, lang, and WINDOWS x WINDOW buckets drawn from all of the text."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows, bags = [], []
        for first, _, data, where in tb.blocks(_lowered(batch.column("text"))):
            codes = subwords(data)
            for i in range(len(where) - 1):
                held = np.concatenate([b[where[i] : max(where[i], where[i + 1] - n + 1)][v[where[i] : max(where[i], where[i + 1] - n + 1)]] for n, b, v in codes])
                if len(held):
                    rng = np.random.default_rng(abs(ids[first + i] or 0))
                    size = min(WINDOW, len(held))
                    half = len(held) - size + 1
                    for s in rng.integers(0, half, WINDOWS):
                        rows.append(first + i)
                        bags.append(np.resize(held[s : s + size], WINDOW).astype(np.int32).tobytes())
        kept = batch.take(pa.array(rows, pa.int64())).select(["doc_id", "lang"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bags, pa.binary())], ["doc_id", "lang", "bag"])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # by bucket: scores of the languages, or the embedding if weight is given
    weight: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        mean = total / np.maximum(count, 1)[:, None]
        logit = ((mean if self.weight is None else mean @ self.weight) + self.bias) / self.temperature
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        return p / p.sum(1, keepdims=True)


def _sgd(bags: np.ndarray, y: np.ndarray, n_languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weight, bias = rng.uniform(-1, 1, (WIDTH, n_languages)), np.zeros(n_languages)
    steps = max(1, EPOCHS * -(-len(y) // BATCH))
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for s in range(0, len(y), BATCH):
            rows = order[s : s + BATCH]
            ids = bags[rows]
            hidden = embed[ids].mean(1)
            logit = hidden @ weight + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ weight.T * (rate / WINDOW)
            weight -= rate / 20 * hidden.T @ p / len(rows) * WIDTH
            bias -= rate / 100 * p.mean(0)
            np.subtract.at(embed, ids.ravel(), np.repeat(back, WINDOW, 0))
            done += 1
    return embed, weight, bias


def train(labelled: DataFrame) -> Model | None:
    """labelled: doc_id, text, lang (not null). None without rows."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r["lang"] for r in counts.collect())
    if not languages:
        return None
    wanted = min(DOCS_PER_LANGUAGE, max(LEAST, SAMPLE // len(languages)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("lang-"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    # one row a language: sent to all tasks while it is small, so that texts do not move
    held = F.broadcast(counts) if len(languages) <= FEW_LANGUAGES else counts
    drawn = labelled.join(held, "lang").where(u < F.lit(float(wanted)) / F.col("n"))
    rows = drawn.select("doc_id", "text", "lang").mapInArrow(_windows, "doc_id long, lang string, bag binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("bag", "ascending")])
    if not rows.num_rows:
        return None
    bags = np.frombuffer(b"".join(rows.column("bag").to_pylist()), np.int32).reshape(-1, WINDOW)
    y = np.searchsorted(languages, rows.column("lang").to_pylist())
    ids = rows.column("doc_id").to_numpy()
    held = (tb.mix(ids.astype(np.uint64)) % np.uint64(5)) == 0
    if held.all() or not held.any():
        held[:] = False
        held[::5] = True
    embed, weight, bias = _sgd(bags[~held], y[~held], len(languages))
    logit = np.concatenate([embed[part].mean(1) @ weight + bias for part in np.array_split(bags[held], -(-held.sum() // 4096))])

    def loss(t: float) -> float:
        z = logit / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y[held]]))

    temperature = min((2.0**e for e in np.arange(-6, 4, 0.25)), key=loss)
    folded = len(languages) <= WIDTH
    model = Model(languages, (embed @ weight if folded else embed).astype(np.float32), None if folded else weight, bias, temperature, 0.0)
    p = np.exp(logit / temperature - (logit / temperature).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == y[held]
    model.threshold = float(np.quantile(p.max(1)[right], LOSS)) if right.any() else 1.0
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score (of the predicted language) and accepted (score reaches the calibrated threshold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            text = batch.column("text").cast(pa.large_string()).fill_null("")
            readable = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            name, score = np.full(n, "und", object), np.zeros(n)
            if model is not None:
                for first, last, data, where in tb.blocks(pc.utf8_lower(text), min(tb.BLOCK_BYTES, (8 << 20) // model.table.shape[1])):
                    total, count = np.zeros((last - first, model.table.shape[1])), np.zeros(last - first, np.int64)
                    for size, bucket, valid in subwords(data):
                        at = np.concatenate(([0], np.cumsum(valid)))
                        ends = np.maximum(where[:-1], np.minimum(where[1:] - size + 1, len(bucket)))
                        s, e = at[np.minimum(where[:-1], len(bucket))], at[np.minimum(ends, len(bucket))]
                        part = np.zeros((at[-1] + 1, model.table.shape[1]))
                        np.cumsum(model.table[bucket[valid]], 0, dtype=np.float64, out=part[1:])
                        total += part[e] - part[s]
                        count += e - s
                    p = model.scores(total, count)
                    name[first:last] = np.array(model.languages, object)[p.argmax(1)]
                    score[first:last] = p.max(1)
            name[~readable], score[~readable] = "und", 0.0
            accepted = readable & (score >= (model.threshold if model is not None else 2.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name, pa.string()), pa.array(score), pa.array(accepted)], [*batch.schema.names, "lang_pred", "score", "accepted"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row; learns from the labelled rows that are not held out."""
    learn = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(learn)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
