"""Token ids of whole texts by a public word-level BPE tokenizer, many words at a time.

The tokenizer splits at white space, then into runs of letters, single digits and runs of other characters, and codes each part by itself. A block of
texts is therefore cut into parts with byte classes, each distinct part is coded by the tokenizers library once a task, and the ids of all
parts are gathered. Only plain ASCII is cut that finely: stretches between white space that hold other characters, an
apostrophe or '<' (which can start a special token) go to the library as they are. Parts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textblocks as tb

#: Distinct parts that a task remembers; bytes of text in one pass, whose working arrays take about 100 times as much.
REMEMBERED, PASS_BYTES = 1 << 20, 1 << 19
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_WHOLE = np.zeros(256, bool)
_WHOLE[[39, 60, *range(9), *range(14, 32), *range(127, 256)]] = True
_CUTS = np.zeros(256, bool)
_CUTS[:128] = True
_CUTS[[39, 60, 124]] = False
_VALUE = np.random.default_rng(20240609).integers(1, 1 << 63, 256, dtype=np.uint64)


def _shift(flags: np.ndarray, first) -> np.ndarray:
    out = np.empty_like(flags)
    out[:1], out[1:] = first, flags[:-1]
    return out


def parts(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of texts data[where[i]:where[i + 1]], whether each goes to the library as it is, and the n + 1 offsets of each text's parts."""
    kind = _CLASS[data]
    inside = kind != _SPACE
    begin = np.zeros(len(data), bool)
    begin[where[:-1][where[:-1] < len(data)]] = True
    before = _shift(kind, _SPACE)
    before[begin] = _SPACE
    # a stretch is cut where a part surely ends: between a plain letter or digit and a sign, but for what can start a contraction or a special token
    wordy, sign = (kind == _LETTER) | (kind == _DIGIT), (kind == _SIGN) & _CUTS[data]
    opens = inside & ((before == _SPACE) | (kind == _SIGN) & (data < 124) & ((before == _LETTER) | (before == _DIGIT)) | wordy & _shift(sign, False) & (before == _SIGN))
    closes = inside & ~_shift((inside & ~opens)[::-1], False)[::-1]
    last = where[1:-1] - 1
    last = last[(last >= 0) & (last < len(data))]
    closes[last] |= inside[last]
    s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    odd = np.concatenate(([0], np.cumsum(_WHOLE[data], dtype=np.int64)))
    kept = odd[e] > odd[s]
    step = np.zeros(len(data) + 1, np.int8)
    step[s[kept]] += 1
    step[e[kept]] -= 1
    as_is = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    start = inside & (opens | ~as_is & ((kind == _DIGIT) | (kind != before)))
    starts = np.flatnonzero(start)
    # a part ends where the next one starts, or with its stretch
    stretch_end = e[np.searchsorted(s, starts, "right") - 1] if len(starts) else starts
    ends = np.minimum(np.append(starts[1:], len(data)), stretch_end) if len(starts) else starts
    return starts, ends, as_is[starts], np.searchsorted(starts, where)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """Read once by a worker, for all its tasks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Coder:
    """Ids of texts with a memory of the parts that a task has met."""

    def __init__(self, tokenizer_path: str):
        self.tokenizer = _tokenizer(tokenizer_path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<") and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = special[-1] if special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.empty(0, np.uint32)
        self.at = np.zeros(1, np.int64)  # offsets of each known part's ids in the pool

    def _plain(self, words: list[str]) -> list[list[int]]:
        """Ids of parts of one class of printable ASCII: what normalising and cutting would leave as they are."""
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w)] for w in words]

    def _as_is(self, words: list[str]) -> list[list[int]]:
        """Ids of whole stretches, many in one text with a special token between them, which none of them holds if it has no '<'."""
        alone = [k for k, w in enumerate(words) if self.mark is None or "<" in w]
        together = [k for k, w in enumerate(words) if self.mark is not None and "<" not in w]
        out: list[list[int]] = [[]] * len(words)
        for k in alone:
            out[k] = self.tokenizer.encode(words[k], add_special_tokens=False).ids
        for s in range(0, len(together), 64):
            some = together[s : s + 64]
            ids = self.tokenizer.encode(self.mark[0].join(words[k] for k in some), add_special_tokens=False).ids
            here: list[int] = []
            bits = [here]
            for i in ids:
                if i == self.mark[1]:
                    here = []
                    bits.append(here)
                else:
                    here.append(i)
            for k, v in zip(some, bits, strict=True):
                out[k] = v
        return out

    def encode(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 offsets of each text's ids."""
        starts, ends, as_is, at = parts(data, where)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(where), np.int64)
        low = tb.ASCII_LOWER[data]
        hashes = tb.range_hashes(_VALUE[low], starts, ends) if not as_is.any() else np.where(as_is, tb.mix(tb.range_hashes(_VALUE[data], starts, ends)), tb.range_hashes(_VALUE[low], starts, ends))
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > REMEMBERED:
            self._forget()
        numbers = [self.known.get(h, -1) for h in unique.tolist()]
        number = np.array(numbers, np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            raw, lowered = data.tobytes(), low.tobytes()
            text = lambda x: (raw if x[2] else lowered)[x[0] : x[1]].decode()
            spans = list(zip(starts[first[new]].tolist(), ends[first[new]].tolist(), as_is[first[new]].tolist(), strict=True))
            plain = [k for k, x in enumerate(spans) if not x[2]]
            odd = [k for k, x in enumerate(spans) if x[2]]
            ids: list[list[int]] = [[]] * len(spans)
            for some, code in ((plain, self._plain), (odd, self._as_is)):
                for k, v in zip(some, code([text(spans[k]) for k in some]), strict=True):
                    ids[k] = v
            n = len(self.known)
            self.known.update(zip(unique[new].tolist(), range(n, n + len(new)), strict=True))
            number[new] = np.arange(n, n + len(new))
            self.pool = np.concatenate((self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(v) for v in ids])))
        word = number[inverse]
        size = self.at[word + 1] - self.at[word]
        total = np.concatenate(([0], np.cumsum(size)))
        out = self.pool[np.repeat(self.at[word] - total[:-1], size) + np.arange(total[-1])]
        return out, total[at]


def coded_pieces(tokenizer_path: str, most: int, closing_id: int):
    """For mapInArrow over (doc_id, text): (doc_id, piece, start, length, ids) with the text's ids and closing_id cut into pieces of most ids;
    ids: unsigned little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer_path)
        for batch in batches:
            for row, end, data, where in tb.blocks(batch.column("text"), PASS_BYTES):
                ids, at = coder.encode(data, where)
                n = end - row
                size = np.diff(at) + 1
                closed = np.full(len(ids) + n, closing_id, "<u4")
                closed[np.arange(len(ids)) + np.repeat(np.arange(n), size - 1)] = ids
                count = -(-size // most)
                own = np.repeat(np.arange(n), count)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * most
                length = np.minimum(most, size[own] - start)
                offsets = np.concatenate(([0], np.cumsum(length))) * 4
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(closed)]).cast(pa.binary())
                doc = batch.column("doc_id").take(pa.array(row + own))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blob], ["doc_id", "piece", "start", "length", "ids"])

    return run
