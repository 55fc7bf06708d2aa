"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words (a run of meta spaces and what follows) are hashed and looked up among the words a task has met; the new ones are
grouped by length and advance together, one character a step. Substring hashes probe the sorted keys of the pieces; at each
end a vectorised maximum over the totals of all pieces that end there decides, and its start is the backpointer.

For a unigram model the maximum is of summed scores. For a BPE model a path is valid when every two neighbours are: pieces a, b
are neighbours exactly when merging their characters by rank never crosses the border between them. At each end just one
piece continues a valid path (its total is 0, the others' minus infinity), and the result equals merging by rank. Which pairs
are valid is worked out for arrays of pairs at once, from the merge trees of the pieces, and kept in a table of fixed size.

A null text has null ids; an empty text has none. Characters without a piece become their UTF-8 bytes' pieces, or the
unknown piece if the model has no bytes. Only models that leave characters and white space as they are (no character map) are taken;
others raise an error. The model file is read by the driver; its arrays travel to the tasks. Further columns pass through, but for those with the name of a result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textblocks as tb

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
META = 0x2581
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6
UNIGRAM, BPE = 1, 2
KEPT_WORDS = 500_000  # a task forgets its words beyond so many
PAIR_SLOTS = 1 << 21
BLOCK_BYTES = 2 << 20  # larger blocks make larger groups of words
NEVER = np.int64(1) << 40
_SALT = np.uint64(0x5851F42D4C957F2D)


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value, i = data[i : i + size], i + size
        elif kind == 5:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        else:
            value, i = data[i : i + 8], i + 8
        yield key >> 3, value


def _hash(text: str) -> int:
    """Polynomial hash of the characters, the first with the lowest power."""
    out = 0
    for v in tb.mix(np.array([ord(c) for c in text], np.uint64) + _SALT).tolist()[::-1]:
        out = (v + tb._BASE * out) & ((1 << 64) - 1)
    return out


def _first_bits(key: np.ndarray) -> np.ndarray:
    """20 bits of a hash, to tell quickly that a substring is no piece."""
    return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


@dataclass
class Pieces:
    """What encoding and decoding need of a model."""

    kind: int
    prefix: bool
    text: list[str]
    types: np.ndarray
    score: np.ndarray
    keys: np.ndarray = field(init=False)  # sorted hashes of the usable pieces
    key_ids: np.ndarray = field(init=False)
    seen: np.ndarray = field(init=False)
    longest: int = field(init=False)
    byte_ids: np.ndarray | None = field(init=False)
    unknown: int = field(init=False)

    def __post_init__(self) -> None:
        usable = np.flatnonzero(np.isin(self.types, (NORMAL, USER)))
        self.longest = max(len(self.text[i]) for i in usable)
        if self.kind == BPE:
            self._trees(usable)
            usable = usable[self.left_n[usable] > 0]
        keys = np.array([_hash(self.text[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], usable[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[_first_bits(self.keys)] = True
        of_byte = np.flatnonzero(self.types == BYTE)
        self.byte_ids = None
        if len(of_byte) == 256:
            self.byte_ids = np.empty(256, np.int64)
            self.byte_ids[[int(self.text[i][3:5], 16) for i in of_byte]] = of_byte
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        self.out = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k not in (NORMAL, USER, UNUSED) else t.replace(chr(META), " ").encode() for t, k in zip(self.text, self.types, strict=True)]

    def _trees(self, usable: np.ndarray) -> None:
        """Merge ranks, mergeable pairs, and each piece's symbols along its left and right border, innermost last."""
        ids = {self.text[i]: int(i) for i in usable}
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        pairs = [(ids[t[:c]], ids[t[c:]], i) for t, i in ids.items() for c in range(1, len(t)) if t[:c] in ids and t[c:] in ids]
        a, b, joined = np.array(pairs, np.int64).reshape(-1, 3).T
        key = a * len(self.text) + b
        order = np.argsort(key)
        self.pair_key, self.pair_id = key[order], joined[order]
        merge = {(x, y): z for x, y, z in pairs}
        deep = self.longest + 1
        self.left = np.full((len(self.text), deep), -1, np.int64)
        self.right = np.full((len(self.text), deep), -1, np.int64)
        self.left_n = np.zeros(len(self.text), np.int64)
        self.right_n = np.zeros(len(self.text), np.int64)
        for text, i in ids.items():
            if all(c in ids for c in text):
                parts = [ids[c] for c in text]
                first, last = [parts[0]], [parts[-1]]
                while len(parts) > 1:
                    best = min(((self.rank[merge[p]], k) for k, p in enumerate(zip(parts[:-1], parts[1:], strict=True)) if p in merge), default=None)
                    if best is None:
                        break
                    k = best[1]
                    parts[k : k + 2] = [merge[parts[k], parts[k + 1]]]
                    if parts[0] != first[-1]:
                        first.append(parts[0])
                    if parts[-1] != last[-1]:
                        last.append(parts[-1])
                if parts == [i]:  # else merging never makes the piece
                    self.left[i, : len(first)], self.right[i, : len(last)] = first, last
                    self.left_n[i], self.right_n[i] = len(first), len(last)

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging by rank leaves the border between pieces a[i] and b[i] (ids, or negative for unknown symbols)."""
        ok = np.ones(len(a), bool)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        i = np.zeros(len(todo), np.int64)
        j = np.zeros(len(todo), np.int64)
        while len(todo):
            x, y = a[todo], b[todo]
            r, s = self.right[x, i], self.left[y, j]
            more_r, more_s = i + 1 < self.right_n[x], j + 1 < self.left_n[y]
            next_r = np.where(more_r, self.rank[self.right[x, np.minimum(i + 1, self.right.shape[1] - 1)]], NEVER)
            next_s = np.where(more_s, self.rank[self.left[y, np.minimum(j + 1, self.left.shape[1] - 1)]], NEVER)
            key = r * len(self.text) + s
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            crossing = np.where(self.pair_key[at] == key, self.rank[self.pair_id[at]], NEVER + 1)
            # of equal ranks the leftmost pair is merged first
            crossed = (crossing < next_r) & (crossing <= next_s)
            ok[todo[crossed]] = False
            go = ~crossed & (more_r | more_s)
            step_r = (next_r <= next_s)[go]
            todo, i, j = todo[go], i[go] + step_r, j[go] + ~step_r
        return ok


def load_pieces(path: str = MODEL_PATH) -> Pieces:
    with open(path, "rb") as f:
        data = f.read()
    text, score, types, kind, prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            text.append(piece.get(1, b"").decode())
            score.append(piece.get(2, 0.0))
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(_fields(value))
            prefix = bool(rules.get(3, 1))
            if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                raise ValueError("models with a character map or that drop white space are not supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {kind} is not supported")
    return Pieces(kind, prefix, text, np.array(types), np.array(score))


class Encoder:
    """Encodes texts; keeps the words and the pairs it has met, up to fixed bounds."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._forget()
        self.slot_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.slot_ok = np.zeros(PAIR_SLOTS, bool)

    def _forget(self) -> None:
        self.word: dict[int, int] = {}  # number of a word, by hash
        self.at, self.flat, self.n_words, self.n_ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32), 0, 0

    def _learn(self, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of new words with these ids."""
        while self.n_words + len(count) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        while self.n_ids + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.n_ids : self.n_ids + len(flat)] = flat
        new = np.arange(self.n_words, self.n_words + len(count))
        self.at[new + 1] = self.n_ids + np.cumsum(count)
        self.n_words, self.n_ids = self.n_words + len(count), self.n_ids + len(flat)
        return new

    def _valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        known = (a >= 0) & (b >= 0)
        key = a * len(self.p.text) + b
        slot = (tb.mix(key.view(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(known & (self.slot_key[slot] != key))
        out = self.slot_ok[slot] | ~known
        if len(miss):
            new = self.p.neighbours(a[miss], b[miss])
            # of new pairs that share a slot the last one stays, in both arrays
            self.slot_key[slot[miss]], self.slot_ok[slot[miss]] = key[miss], new
            out[miss] = new
        return out

    def viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of words of one length; chars: code points, a row for each word."""
        p, (n, length) = self.p, chars.shape
        value = np.ascontiguousarray(tb.mix(chars.astype(np.uint64) + _SALT).T)
        base = np.uint64(tb._BASE)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -1, np.int64)
        start = np.zeros((length + 1, n), np.int64)
        for end in range(1, length + 1):
            hashed = np.zeros(n, np.uint64)
            found = []  # (words, pieces) by size
            for size in range(1, min(p.longest, end) + 1):
                hashed = value[end - size] + base * hashed
                maybe = np.flatnonzero(p.seen[_first_bits(hashed)])
                key = hashed[maybe]
                at = np.minimum(np.searchsorted(p.keys, key), len(p.keys) - 1)
                real = p.keys[at] == key
                found.append((maybe[real], p.key_ids[at[real]]))
            words, piece = found[0]
            if len(words) < n:
                # a symbol without a piece is -1 - code point
                symbol = -1 - chars[:, end - 1].astype(np.int64)
                symbol[words] = piece
                found[0] = (np.arange(n), symbol)
            # what each piece would add, longest pieces first; the maximum decides, the first one on ties
            total = np.full((len(found), n), -np.inf)
            ids = np.full((len(found), n), -1, np.int64)
            for row, (words, piece) in enumerate(found[::-1]):
                s = end - len(found) + row
                fine = best[s][words] > -np.inf
                words, piece = words[fine], piece[fine]
                if p.kind == BPE:
                    gain = np.where(self._valid(last[s][words], piece), 0.0, -np.inf) if s and len(words) else 0.0
                else:
                    gain = np.where(piece >= 0, p.score[np.maximum(piece, 0)], p.score.min() - 10)
                total[row, words], ids[row, words] = best[s][words] + gain, piece
            pick, every = total.argmax(0), np.arange(n)
            best[end], last[end], start[end] = total[pick, every], ids[pick, every], end - len(found) + pick
        steps, end = [], np.full(n, length)
        every = np.arange(n)
        while (end > 0).any():
            steps.append(np.where(end > 0, last[end, every], NEVER))
            end = np.where(end > 0, start[end, every], 0)
        path = np.array(steps[::-1]).T  # short paths are padded in front
        used = path != NEVER
        flat, count = path[used], used.sum(1)
        return self._bytes(flat, count) if (flat < 0).any() else (flat, count)

    def _bytes(self, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown symbols as the pieces of their bytes; without such pieces, a run of them as the unknown piece."""
        p, at = self.p, np.concatenate(([0], np.cumsum(count)))
        if p.byte_ids is None:
            flat = np.where(flat < 0, p.unknown, flat)
            keep = np.ones(len(flat), bool)
            keep[1:] = (flat[1:] != p.unknown) | (flat[:-1] != p.unknown)
            keep[at[:-1]] = True
            return flat[keep], tb.row_sums(keep.astype(np.int64), at)
        plain = (flat < 0) & (flat >= -128)
        flat[plain] = p.byte_ids[-1 - flat[plain]]
        if (flat >= 0).all():
            return flat, count
        parts = [[t] if t >= 0 else p.byte_ids[list(chr(-1 - t).encode())].tolist() for t in flat.tolist()]
        return np.array([t for x in parts for t in x], np.int64), tb.row_sums(np.array([len(x) for x in parts]), at)

    def encode(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of UTF-8 texts."""
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(where), np.int64)
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        # offsets in characters: bytes that do not continue a character
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[where]
        cp[cp == 32] = META
        full = np.diff(at) > 0
        if self.p.prefix:
            cp = np.insert(cp, at[:-1][full], META)
            at = at + np.concatenate(([0], np.cumsum(full)))
        meta = cp == META
        begins = meta.copy()
        begins[1:] &= ~meta[:-1]
        begins[at[:-1][full]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(cp))
        code = tb.range_hashes(tb.mix(cp.astype(np.uint64) + _SALT), starts, ends)
        distinct, first, which = np.unique(code, return_index=True, return_inverse=True)
        if len(self.word) > KEPT_WORDS:
            self._forget()
        entry = np.array([self.word.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(entry < 0)
        length = (ends - starts)[first[new]]
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            size = int(length[order[s]])
            step = max(1, (1 << 18) // size)
            for k in range(s, e, step):
                group = new[order[k : min(k + step, e)]]
                chars = cp[starts[first[group]][:, None] + np.arange(size)]
                entry[group] = self._learn(*self.viterbi(chars))
        self.word.update(zip(distinct[new].tolist(), entry[new].tolist(), strict=True))
        begin, held = self.at[entry], self.at[entry + 1] - self.at[entry]
        count = held[which]
        ids = self.flat[np.repeat(begin[which] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[np.searchsorted(starts, at)]


class Decoder:
    def __init__(self, pieces: Pieces):
        self.prefix = pieces.prefix
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in pieces.out])))
        self.data = np.frombuffer(b"".join(pieces.out), np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of flat ids and offsets; bytes that are not UTF-8 become replacement characters."""
        size = (self.at[1:] - self.at[:-1])[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        data = self.data[np.repeat(self.at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cut = total[at].tolist()
        texts = [data[s:e].decode("utf-8", "replace") for s, e in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


def encode_pieces(docs: DataFrame, path: str = MODEL_PATH, check: bool = True) -> DataFrame:
    """docs (text and any others) with ids, n_pieces and, if check, round_trip: whether decoding gives the text again."""
    pieces = load_pieces(path)
    docs = docs.drop("ids", "n_pieces", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            for first, last, data, where in tb.blocks(text, BLOCK_BYTES):
                ids, at = encoder.encode(data, where)
                part, null = batch.slice(first, last - first), text.slice(first, last - first).is_null()
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=null)
                more = [values, pa.array(np.diff(at), mask=null.to_numpy(zero_copy_only=False))]
                if check:
                    same = np.array([a == b for a, b in zip(decoder.decode(ids, at), text.slice(first, last - first).to_pylist(), strict=True)], bool)
                    more.append(pa.array(same, mask=null.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*batch.schema.names, "ids", "n_pieces", *["round_trip"] * check])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), *[T.StructField("round_trip", T.BooleanType())] * check]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode_pieces(rows: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """rows (ids and any others) with decoded; null ids give null, ids outside the model raise an error."""
    pieces = load_pieces(path)
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            flat = np.array([i for x in lists for i in x], np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(pieces.out)):
                raise ValueError("ids outside the model")
            texts = decoder.decode(flat, np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64))
            null = batch.column("ids").is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=null)], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
