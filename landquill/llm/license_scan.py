"""License scan by patience alignment.

Words (runs of letters and digits, A-Z in lower case) of a text are aligned with those of each template: words that are unique
on both sides anchor the alignment, the longest increasing subsequence of the anchors is kept, and the gaps between them are
aligned again; a gap without anchors is aligned by its longest common subsequence (gaps are no longer than a stretch, so that this is
bounded; a row of its table is one long integer). Coverage is the part of the template's words that are aligned.

Stretches come from an upper bound, not from a guess: the words that text and template share are counted, and only where a
window of ``SPREAD`` times the template's length holds enough of them, and of each word no more than the template has, is
anything aligned. Texts are read whole, in blocks.

A template counts where it reaches ``coverage`` and its marked words, which tell licenses apart, are aligned. Where several do,
the one with the most aligned words takes its words; another is reported beside it only if its own marked words are
not among them (a template without marked words: if no more than half of its aligned words are).

One row per document and license that is found anywhere: the best coverage (the first such stretch, on ties), the numbers of
the first and last aligned word, and how many stretches were found. Null and empty texts give no row.
Further columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .license_texts import library

COVERAGE, SPREAD = 0.8, 1.5

#: Four short notices by name. The scan's default is all of ``license_texts.library()``; users can pass their own templates.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[c for c in range(128) if not chr(c).isalnum()]] = 32


def license_words(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tb.words(_TO_SPACE[data], where)


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        below[i] = piles[p - 1] if p else -1
        tops[p : p + 1] = [v]
        piles[p : p + 1] = [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def _common(a: list[int], b: list[int], at_a: int, at_b: int) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of positions; a row of the table is one bit vector."""
    n, m = len(a), len(b)
    spots: dict[int, int] = {}
    for j, w in enumerate(b):
        spots[w] = spots.get(w, 0) | 1 << (m - 1 - j)
    whole = (1 << m) - 1
    # a zero at bit m - 1 - j: b[j:] has one more word in common with a[i:] than b[j + 1:] has
    rows = [whole] * (n + 1)
    for i in range(n - 1, -1, -1):
        row = rows[i + 1]
        same = row & spots.get(a[i], 0)
        rows[i] = ((row + same) | (row - same)) & whole
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((at_a + i, at_b + j))
            i, j = i + 1, j + 1
            continue
        low = (1 << (m - j - 1)) - 1
        # words in common of (a[i + 1:], b[j:]) and of (a[i:], b[j + 1:])
        down = m - j - (rows[i + 1] & (low << 1 | 1)).bit_count()
        right = m - j - 1 - (rows[i] & low).bit_count()
        if down >= right:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[int], b: list[int], at_a: int = 0, at_b: int = 0) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), increasing in both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    out = [(at_a + k, at_b + k) for k in range(head)]
    a, b, at_a, at_b = a[head:], b[head:], at_a + head, at_b + head
    if not a or not b:
        return out
    in_a, in_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    anchors = [(i, place[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in place]
    anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
    if not anchors:
        return out + (_common(a, b, at_a, at_b) if in_a.keys() & in_b.keys() else [])
    i0 = j0 = 0
    for i, j in [*anchors, (len(a), len(b))]:
        out += patience(a[i0:i], b[j0:j], at_a + i0, at_b + j0)
        if i < len(a):
            out.append((at_a + i, at_b + j))
        i0, j0 = i + 1, j + 1
    return out


def _stretches(spots: np.ndarray, needed: int, window: int) -> list[tuple[int, int]]:
    """(first, last + 1) of stretches of at most two windows that cover every window with enough shared words."""
    if len(spots) < needed:
        return []
    starts = np.flatnonzero(spots[needed - 1 :] - spots[: len(spots) - needed + 1] < window)
    out: list[list[int]] = []
    for s in spots[starts].tolist():
        # a new stretch unless this window still fits the last one
        if out and s + window <= out[-1][0] + 2 * window:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [(s, e) for s, e in out]


def _form(text: str, marked: bool) -> tuple[list[int], list[int], list[int]]:
    """Words of a template, the numbers of those in braces, and of those whose next word is in the same braces."""
    words: list[int] = []
    marks: list[int] = []
    joined: list[int] = []
    for k, part in enumerate(re.split(r"[{}]", text) if marked else [text]):
        data = np.frombuffer(part.encode(), np.uint8)
        own = license_words(data, np.array([0, len(data)]))[0].tolist()
        if k % 2:
            marks += range(len(words), len(words) + len(own))
            joined += range(len(words), len(words) + len(own) - 1)
        words += own
    return words, marks, joined


def scan_licenses(docs: DataFrame, templates: dict[str, str] | list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, n_stretches; docs: doc_id, text.

    templates: (license, text) pairs, where braces mark words that have to be there, side by side, or plain texts by license.
    """
    forms = []
    marked = not isinstance(templates, dict)
    for name, text in templates.items() if isinstance(templates, dict) else library() if templates is None else templates:
        words, marks, joined = _form(text, marked)
        if words:
            forms.append((name, words, int(np.ceil(coverage * len(words) - 1e-9)), int(SPREAD * len(words)) + 1, marks, joined))
    vocabulary = np.unique(np.array([w for _, ws, *_ in forms for w in ws], np.uint64))
    counts = []
    for _, ws, *_ in forms:
        kinds, n = np.unique(np.array(ws, np.uint64), return_counts=True)
        counts.append((np.searchsorted(vocabulary, kinds), n))

    def found(words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(text, template, aligned pairs) of every stretch that a template covers."""
        if not len(words) or not len(vocabulary):
            return
        spot = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        place = np.flatnonzero(vocabulary[spot] == words)
        kind = spot[place]
        present = np.bincount(kind, minlength=len(vocabulary)) > 0
        mine_of = np.zeros(len(vocabulary), bool)
        for k, (_, form, needed, window, marks, joined) in enumerate(forms):
            kinds, most = counts[k]
            if not present[np.searchsorted(vocabulary, np.array([form[m] for m in marks], np.uint64))].all():
                continue
            mine_of[kinds] = True
            held = np.flatnonzero(mine_of[kind])
            mine_of[kinds] = False
            mine, own = place[held], kind[held]
            cut = np.searchsorted(mine, at)
            for d in np.flatnonzero(np.diff(cut) >= needed).tolist():
                last = -1
                for s, e in _stretches(mine[cut[d] : cut[d + 1]], needed, window):
                    s, e = max(s, last + 1), min(e, int(at[d + 1]))
                    # no more words can be aligned than both sides hold of each kind
                    inside = own[np.searchsorted(mine, s) : np.searchsorted(mine, e)]
                    if np.minimum(np.bincount(inside, minlength=len(vocabulary))[kinds], most).sum() < needed:
                        continue
                    pairs = patience(words[s:e].tolist(), form, s)
                    spots = {j: i for i, j in pairs}
                    if len(pairs) >= needed and spots.keys() >= set(marks) and all(spots[j + 1] == spots[j] + 1 for j in joined):
                        last = pairs[-1][0]
                        yield d, k, pairs

    def hits(words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, str, float, int, int, int]]:
        by_text: dict[int, list] = {}
        for d, k, pairs in found(words, at):
            by_text.setdefault(d, []).append((-len(pairs), len(forms[k][1]), k, pairs))
        for d in sorted(by_text):
            taken: set[int] = set()
            rows: dict[str, tuple] = {}
            for _, size, k, pairs in sorted(by_text[d], key=lambda c: (*c[:3], c[3][0])):
                name, marks = forms[k][0], set(forms[k][4])
                # told apart by words that a better template has aligned already, or half explained by it
                ours = [i for i, j in pairs if not marks or j in marks]
                n_taken = sum(i in taken for i in ours)
                if n_taken == len(ours) or (not marks and 2 * n_taken > len(ours)):
                    continue
                taken.update(i for i, _ in pairs)
                best = rows.get(name, (0.0, 0, 0, 0))
                share, first = len(pairs) / size, pairs[0][0] - int(at[d])
                if (-share, first) < (-best[0], best[1]):
                    best = (share, first, pairs[-1][0] - int(at[d]), best[3])
                rows[name] = (*best[:3], best[3] + 1)
            for name in sorted(rows):
                yield (d, name, *rows[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, where in tb.blocks(batch.column("text")):
                rows = list(hits(*license_words(data, where)))
                if rows:
                    d, *rest = (list(x) for x in zip(*rows, strict=True))
                    ids = batch.column("doc_id").take(pa.array([first + i for i in d]))
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, rest)], ["doc_id", "license", "coverage", "first_word", "last_word", "n_stretches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, n_stretches long")
