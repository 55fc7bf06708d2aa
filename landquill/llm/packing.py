"""Best-fit packing of documents into sequences of bounded length by a grouping genetic algorithm on islands.

An individual is a grouping: the sequence (bin) of each document. Crossover injects whole well-filled bins of one parent into the other,
removes the other's bins that hold any of the same documents, and best-fits the displaced documents; mutation dissolves the worst-filled bins
and some others. Documents are dealt at random into blocks of about ``BLOCK`` by a row number, so that equal ids or lengths make no large group.
Each block evolves on ``ISLANDS`` islands, tasks of their own, which send their elite to the next island between epochs; a block stops when it needs
no more bins than its tokens fill.

A block leaves at most part of a bin unused beyond its tokens. To save those too, each block gives up its worst-filled bins (one in
``GIVEN_UP``), whose documents are dealt and packed again at the next level, until one block is left. Pieces of full length are sequences by themselves.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .word_ids import coded_pieces

BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 2, 3, 8, 6
GIVEN_UP = 24
CLOSING_ID = 0


def document_pieces(docs: DataFrame, tokenizer_path: str, most: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and CLOSING_ID, cut into pieces of most ids if there are more.

    ids are unsigned little-endian 32-bit numbers in one binary. A null or empty text is CLOSING_ID alone; rows that share a doc_id, or have none, are
    documents of their own. Other columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(coded_pieces(tokenizer_path, most, CLOSING_ID), f"doc_id {kind}, piece int, start long, length long, ids binary")


class Groupings:
    """Groupings of one island's documents, by their lengths."""

    def __init__(self, length: np.ndarray, capacity: int, rng: np.random.Generator):
        self.length, self.capacity, self.rng = length, capacity, rng
        self.least = -(-int(length.sum()) // capacity)

    def best_fit(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """bins (-1: none yet) with items, in this order, each put where it leaves the least room; numbers 0, 1, … without gaps."""
        out = bins.copy()
        placed = out >= 0
        used, number = np.unique(out[placed], return_inverse=True)
        out[placed] = number
        room = self.capacity - np.bincount(number, self.length[placed], len(used)).astype(np.int64)
        free = sorted((int(r), b) for b, r in enumerate(room) if r)
        n = len(used)
        for i, size in zip(items.tolist(), self.length[items].tolist(), strict=True):
            k = bisect_left(free, (size, -1))
            if k < len(free):
                r, b = free.pop(k)
            else:
                r, b, n = self.capacity, n, n + 1
            out[i] = b
            if r > size:
                insort(free, (r - size, b))
        return out

    def large_first(self, items: np.ndarray) -> np.ndarray:
        return items[np.argsort(-self.length[items], kind="stable")]

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.length).astype(np.int64)

    def worth(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins are better, then uneven filling, which leaves the most room in few bins."""
        fill = self.fills(bins) / self.capacity
        return -len(fill), float((fill * fill).sum())

    def fresh(self, n: int, first: bool) -> list[np.ndarray]:
        every, none = np.arange(len(self.length)), np.full(len(self.length), -1)
        orders = [self.large_first(every)] if first else []
        while len(orders) < n:
            orders.append(every[np.argsort(-self.length * self.rng.uniform(0.7, 1, len(every)), kind="stable")])
        return [self.best_fit(none, o) for o in orders]

    def cross(self, into: np.ndarray, of: np.ndarray) -> np.ndarray:
        fill = self.fills(of)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = np.zeros(len(fill), bool)
        chosen[self.rng.choice(good, max(1, len(good) // 4), replace=False)] = True
        injected = chosen[of]
        hit = np.zeros(into.max() + 1, bool)
        hit[into[injected]] = True
        out = np.where(hit[into], -1, into)
        out[injected] = into.max() + 1 + of[injected]
        return self.best_fit(out, self.large_first(np.flatnonzero(out < 0)))

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        fill = self.fills(bins)
        gone = np.zeros(len(fill), bool)
        gone[np.argsort(fill, kind="stable")[: max(1, len(fill) // 50)]] = True
        gone[self.rng.integers(0, len(fill), max(1, len(fill) // 20))] = True
        out = np.where(gone[bins], -1, bins)
        return self.best_fit(out, self.large_first(np.flatnonzero(out < 0)))

    def evolve(self, people: list[np.ndarray], generations: int) -> list[np.ndarray]:
        """The people after some generations, best first."""
        ranked = sorted(((self.worth(p), k, p) for k, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
        people = [p for _, _, p in ranked]
        worth = [w for w, _, _ in ranked]
        for _ in range(generations):
            if -worth[0][0] <= self.least:
                break
            a, b = self.rng.permutation(len(people))[:2] if len(people) > 1 else (0, 0)
            a, b = sorted((int(a), int(b)))
            child = self.mutate(self.cross(people[a], people[b]))
            value = self.worth(child)
            if value > worth[-1]:
                people[-1], worth[-1] = child, value
                order = sorted(range(len(people)), key=lambda k: (worth[k], -k), reverse=True)
                people, worth = [people[k] for k in order], [worth[k] for k in order]
        return people


_STATE = "block long, island int, nos binary, lengths binary, people binary, bins int, worth double"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.float64())
    names = ("block", "island", "nos", "lengths", "people", "bins", "worth")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))


def _row(block: int, island: int, nos: np.ndarray, length: np.ndarray, groups: Groupings, people: list[np.ndarray]) -> tuple:
    bins, worth = groups.worth(people[0])
    return block, island, nos.astype(np.int64).tobytes(), length.astype(np.int32).tobytes(), np.array(people, np.int32).tobytes(), -bins, worth


def _settle(capacity: int, level: int):
    """The first people of one (block, island)."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("no")
        nos, length = part.column("no").to_numpy(), part.column("length").to_numpy()
        block, island = part.column("block")[0].as_py(), part.column("island")[0].as_py()
        groups = Groupings(length, capacity, np.random.default_rng((level, block, island, 0)))
        people = groups.fresh(1, island == 0)
        if -groups.worth(people[0])[0] > groups.least:
            people = groups.evolve(people + groups.fresh(POPULATION - 1, False), GENERATIONS)
        return pa.Table.from_batches([_packed([_row(block, island, nos, length, groups, people)])])

    return run


def _live_on(capacity: int, level: int, epoch: int):
    """Another epoch of each island, with the elite that came to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                nos, length = np.frombuffer(r["nos"], np.int64), np.frombuffer(r["lengths"], np.int32).astype(np.int64)
                groups = Groupings(length, capacity, np.random.default_rng((level, r["block"], r["island"], epoch)))
                people = list(np.frombuffer(r["people"], np.int32).astype(np.int64).reshape(-1, len(length)))
                people = people[: max(1, POPULATION - 1)] + [np.frombuffer(r["elite"], np.int32).astype(np.int64)]
                if len(people) < POPULATION:
                    people += groups.fresh(POPULATION - len(people), False)
                out.append(_row(r["block"], r["island"], nos, length, groups, groups.evolve(people, GENERATIONS)))
            if out:
                yield _packed(out)

    return run


def _unpacked(capacity: int, given_up: int):
    """(no, length, bin, offset, again) of the best grouping of each block; again: its bin is one of those given up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                nos, length = np.frombuffer(r["nos"], np.int64), np.frombuffer(r["lengths"], np.int32).astype(np.int64)
                bins = np.frombuffer(r["people"], np.int32)[: len(length)].astype(np.int64)
                order = np.lexsort((nos, bins))
                bins, nos, length = bins[order], nos[order], length[order]
                before = np.cumsum(length) - length
                first = np.searchsorted(bins, bins)
                fill = np.bincount(bins, length)
                again = np.zeros(len(fill), bool)
                if given_up:
                    worst = np.argsort(fill, kind="stable")[: -(-len(fill) // given_up)]
                    again[worst[fill[worst] < capacity]] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nos), r["block"])), pa.array(nos), pa.array(length), pa.array(bins), pa.array(before - before[first]), pa.array(again[bins])], ["block", "no", "length", "bin", "offset", "again"])

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """(no, sequence_id, offset) of pieces (no, length): no is a unique long, length is 1 to capacity.

    Lengths of a sequence add up to capacity at most; its pieces lie one behind the other from 0. Results depend only on no and length. An empty table
    gives no rows.
    """
    rows = pieces.select(F.col("no").cast("long").alias("no"), F.col("length").cast("long").alias("length"))
    # sequence_id: 16 * number + kind; kind 0: a full piece, k + 1: a bin of level k
    out = [rows.where(F.col("length") == capacity).select("no", (F.col("no") * 16).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = rows.where(F.col("length") < capacity)
    n, level = left.count(), 0
    while n:
        blocks = -(-n // BLOCK)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("no", F.lit(level)), F.lit(blocks)))
        islands = dealt.withColumn("island", F.explode(F.expr(f"sequence(0, {ISLANDS - 1})")))
        state = materialise(islands.groupBy("block", "island").applyInArrow(_settle(capacity, level), _STATE))
        for epoch in range(1, EPOCHS):
            moved = state.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.expr("substring(people, 1, octet_length(lengths))").alias("elite"))
            state = materialise(state.join(moved, ["block", "island"]).mapInArrow(_live_on(capacity, level, epoch), _STATE))
        best = state.groupBy("block").agg(F.min_by(F.struct("nos", "lengths", "people"), F.struct("bins", -F.col("worth"), "island")).alias("s")).select("block", "s.*")
        done = materialise(best.mapInArrow(_unpacked(capacity, GIVEN_UP if blocks > 1 else 0), "block long, no long, length long, bin long, offset long, again boolean"))
        out.append(done.where("not again").select("no", ((F.col("block") * 1_048_576 + F.col("bin")) * 16 + level + 1).alias("sequence_id"), "offset"))
        left = done.where("again").select("no", "length")
        n, level = left.count() if blocks > 1 else 0, level + 1
    return reduce(DataFrame.unionByName, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """The pieces of documents (see document_pieces) with their sequence_id and offset: sequences of at most capacity ids, as few as the search finds."""
    pieces = materialise(document_pieces(docs, tokenizer_path, capacity).withColumn("no", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces, capacity), "no").drop("no")
