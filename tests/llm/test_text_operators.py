"""Operators on documents against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from landquill.llm import language_id, license_scan, license_texts, line_dedup, mixing, ngram_join, quality, sentence_pieces
from landquill.llm import textblocks as tb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel iris juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "y"]) for _ in range(n))


def edge_rows():
    """Null and empty values, blank, very long and repeated texts, repeated rows."""
    rng = random.Random(5)
    long_text = prose(rng, 60_000)
    base = prose(rng, 60)
    near = base.split()
    near[30] = "changed"
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", None, 1),
        (3, " ".join(near), None, "b", 1),
        (4, None, "en", "a", None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "en", "b", 4),
        (7, long_text, "en", "a", 1),
        (8, long_text, "fr", "a", 1),
        (None, base, "en", "a", 1),
        (9, "x", "en", "a", 1),
        (9, "x", "en", "a", 1),
        (10, "1 2 3 !!!", "en", "a", 9),
        (11, base.upper(), "en", "a", 1),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_components(rows, k, t):
    def grams(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset({tuple(w)}) if w else frozenset())

    sets = {i: grams(x) for i, x in rows if i is not None}
    holders, root = defaultdict(list), {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= t * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "t"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(small, k, t):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(small, k, (t, 100)).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in small.collect()], k, t)


def test_ngram_join_of_many_near_copies_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 80).split()
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 700)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, 3, (80, 100)).collect()}
    assert got == brute_components(rows, 3, 80)


def test_ngram_join_finds_what_the_first_n_grams_miss(small, spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "first_part", lambda num, den: 1)
    monkeypatch.setattr(ngram_join, "RUN_ROWS", 3)
    monkeypatch.setattr(ngram_join, "_PART", 50)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(small, 5, (80, 100)).collect()}
    assert got == brute_components(rows, 5, 80)


def test_rows_that_share_a_doc_id_are_judged_by_their_own_texts(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = spark.createDataFrame([(2, a), (5, a + " more"), (5, b), (9, b), (5, c), (5, c)], "doc_id long, text string")
    got = {(r.doc_id, r.text_key): r.component_id for r in ngram_join.ngram_components(docs).collect()}
    keys = {(r.doc_id, r.text): r.k for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as k").collect()}
    assert {t: got[t[0], k] for t, k in keys.items()} == {(2, a): 2, (5, a + " more"): 2, (5, b): 5, (9, b): 5, (5, c): 5}
    line = "A line that a document of another number has as well."
    rows = [(1, line), (2, f"{line}\nkeep me, for I am alone in all of this."), (2, "unique line that nobody else has ever written\nzzz"), (2, "unique line that nobody else has ever written\nzzz")]
    left = sorted(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == sorted([line, "keep me, for I am alone in all of this.", rows[2][1], rows[3][1]])


def test_ngram_join_edges(edges, spark):
    extra = edges.withColumnsRenamed({"n_chars": "n", "source": "token", "lang": "component"})
    rows = ngram_join.ngram_components(extra, 5, (80, 100)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 13
    assert [got[i][1] for i in (1, 2, 3, 11)] == [1, 1, 1, 1]
    assert got[7][1] == got[8][1] == 7
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6) and got[9] == (1, 9)
    assert got[None][1] == 1
    assert ngram_join.ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_lines(rows, edits, least, gone=None):
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t is not None):
        for n, line in enumerate(t.split("\n")):
            if len(line) >= least:
                first.setdefault(line, (i, n))
    lines = list(first)
    near = lambda a, b: abs(len(a) - len(b)) <= edits and sum((Counter(a) - Counter(b)).values()) <= edits and distance(a, b) <= edits
    late = {max((a, b), key=first.get) for x, a in enumerate(lines) for b in lines[:x] if near(a, b)}
    if gone is not None:
        gone |= {(i, n) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")) if len(x) >= least and (x in late or first[x] != (i, n))}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if len(x) < least or (x not in late and first[x] == (i, n))) for i, t in rows if i is not None}


def line_rows():
    rng = random.Random(2)
    pool = [prose(rng, rng.randint(4, 9)) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                k = rng.randrange(len(line))
                line[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "é", "日"])
            lines.append("".join(line))
        rows.append((i, "\n".join([*lines, "}", "", prose(rng, 5)])))
    return rows


@pytest.mark.parametrize(("run_lines", "run_rows"), [(4096, 1_000_000), (8, 1_000_000), (8, 5)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, run_lines, run_rows):
    monkeypatch.setattr(line_dedup, "RUN_LINES", run_lines)
    monkeypatch.setattr(line_dedup, "RUN_ROWS", run_rows)
    if run_rows < 100:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = line_rows()
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_lines(rows, 2, 24)


def test_line_dedup_edges(edges, spark):
    extra = edges.withColumnsRenamed({"n_chars": "n_lines", "source": "line", "lang": "lines"})
    rows = line_dedup.dedup_lines(extra).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert len(rows) == 13
    assert got[1][0].n_dropped == 0 and got[2][0].text == "" and got[2][0].n_dropped == 1
    assert got[4][0].text is None and got[4][0].n_lines == 0
    assert got[5][0].text == "" and got[6][0].text == " \n\t "
    assert got[7][0].n_dropped == 0 and got[8][0].n_dropped == 1
    assert got[None][0].text == got[1][0].text
    assert [r.text for r in got[9]] == ["x", "x"]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_banded_distance():
    rng = random.Random(3)
    for limit in (1, 2, 3):
        a, b = [], []
        for _ in range(300):
            x = "".join(rng.choice("abc") for _ in range(rng.randint(8, 30)))
            y = list(x)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(y))
                y[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
            a.append(x)
            b.append("".join(y))
        plain = []
        for x, y in zip(a, b, strict=True):
            last = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                now = [i]
                for j, d in enumerate(y, 1):
                    now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
                last = now
            plain.append(min(last[-1], limit + 1))
        assert line_dedup.banded_distance(a, b, limit).tolist() == plain


def test_language_id_on_held_out_documents(small):
    rows = language_id.identify(small.where("lang is not null")).join(small.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_prediction_equals_a_plain_loop(small, spark):
    rng = np.random.default_rng(3)
    for width, weight in ((3, None), (language_id.WIDTH, rng.normal(size=(language_id.WIDTH, 20)))):
        names = [f"l{i:02}" for i in range(3 if weight is None else 20)]
        model = language_id.Model(names, rng.normal(size=(language_id.BUCKETS, width)).astype(np.float32), weight, rng.normal(size=len(names)), 0.7, 0.2)
        for r in language_id.predict(small.limit(40), model).collect():
            data = (r.text or "").lower().encode()
            total, count = np.zeros(width), 0
            for n in (3, 4):
                for i in range(len(data) - n + 1):
                    part = data[i : i + n]
                    if not any(c in b" \t\n\x0b\x0c\r" for c in part[1:-1]):
                        code = n + sum(int(tb._BYTE_VALUE[c]) * int(tb._PLACE[j]) for j, c in enumerate(part)) & (1 << 64) - 1
                        bucket = ((code ^ (code >> 29)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - language_id.BITS)
                        total, count = total + model.table[bucket], count + 1
            logit = total / max(count, 1)
            logit = ((logit if weight is None else logit @ weight) + model.bias) / model.temperature
            p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
            if any(c.isalpha() for c in r.text or ""):
                assert r.lang_pred == names[int(p.argmax())] and abs(r.score - p.max()) < 1e-6
            else:
                assert r.lang_pred == "und"


def test_language_id_with_many_languages(spark):
    rng = random.Random(2)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for i in range(30)}
    rows = [(i * 31 + j, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i in range(40) for j, k in enumerate(words)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    right = {i: k for i, _, k in rows}
    assert np.mean([r.lang_pred == right[r.doc_id] for r in got if r.held_out]) > 0.9 and len({r.lang_pred for r in got}) == 30


def test_language_id_edges(edges, spark):
    extra = edges.withColumnsRenamed({"source": "score", "n_chars": "accepted"})
    rows = language_id.identify(extra).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and set(got[1].asDict()) == {"doc_id", "held_out", "lang_pred", "score", "accepted"}
    for i in (4, 5, 6, 10):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[9].lang_pred in ("en", "fr") and got[7].lang_pred == got[8].lang_pred
    assert language_id.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    none = language_id.identify(edges.withColumn("lang", edges["lang"].substr(9, 1).eqNullSafe("x").cast("string").substr(9, 1))).where("lang_pred = 'und'").count()
    assert none >= 4


def test_quality_against_brute_force(small, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.resample(small, labels.where("quality = 1")).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    size = quality.BUCKETS
    buckets = {}
    for r in small.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        word, at = tb.words(data, np.array([0, len(data)]))
        pair, _ = tb.shingles(word, at, 2)
        buckets[r.doc_id] = (np.concatenate((word, pair)) >> np.uint64(64 - quality.BITS)).astype(np.int64)
    raw = np.bincount(np.concatenate(list(buckets.values())), minlength=size)
    want = np.bincount(np.concatenate([b for i, b in buckets.items() if i in good]), minlength=size)
    ratio = np.log((want + 1) / (want.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    weight = {i: ratio[b].sum() for i, b in buckets.items() if len(b)}
    assert all(abs(got[i].log_weight - m) < 1e-6 for i, m in weight.items())
    edge = np.quantile([got[i].log_weight for i in good if i in weight], quality.LOSS)
    k = sum(got[i].log_weight >= edge for i in weight)
    best = sorted(weight, key=lambda i: (-got[i].gumbel_key, i))[:k]
    assert {i for i, r in got.items() if r.kept} == set(best)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()} & set(got)
    assert np.mean([got[i].kept for i in good & set(got)]) > 0.97
    assert np.mean([got[i].kept for i in bad]) < 0.5


def test_gumbel_noise_draws_by_weight(spark):
    # ten texts of the target and many that share a part of its words: kept more often the more they share
    words = [f"w{i}" for i in range(40)]
    target = [(i, " ".join(words)) for i in range(10)]
    rest = [(100 + i, " ".join(words[: i % 4] + [f"x{i % 7}"] * (3 - i % 4))) for i in range(400)]
    docs = spark.createDataFrame(target + rest, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    kept, weight = [], {}
    for seed in range(3):
        rows = quality.resample(docs, good, seed=seed, loss=0.5).collect()
        noise = {r.doc_id: r.gumbel_key - r.log_weight for r in rows}
        assert np.std(list(noise.values())) > 1
        weight = {r.doc_id: r.log_weight for r in rows}
        small = spark.createDataFrame([(i, weight[i] + noise[i]) for i in noise if i >= 100], "doc_id long, key double")
        key, last = quality.kth_largest(small, 100)
        kept.append({i for i in noise if i >= 100 and (weight[i] + noise[i] > key or (weight[i] + noise[i] == key and i <= last))})
        assert len(kept[-1]) == 100
    assert kept[0] != kept[1] != kept[2]
    often = {m: np.mean([100 + i in k for k in kept for i in range(400) if i % 4 == m]) for m in range(4)}
    assert often[0] < often[1] < often[2] < often[3]


def test_kth_largest_with_ties(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, float(rng.choice([1.0, 2.0, 2.0, 3.5, rng.random()]))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for few in (1000, 3):
        monkeypatch.setattr(quality, "FEW", few)
        for k in (1, 7, 250, 500):
            assert quality.kth_largest(df, k) == (order[k - 1][1], order[k - 1][0])


def test_quality_edges(edges, spark):
    target = spark.createDataFrame([(1,), (1,), (7,), (None,), (999,)], "doc_id long")
    extra = edges.withColumnsRenamed({"lang": "kept", "n_chars": "log_weight", "source": "bucket"})
    rows = quality.resample(extra, target).collect()
    assert len(rows) == 13 and set(rows[0].asDict()) == {"doc_id", "text", "bucket", "n_ngrams", "log_weight", "gumbel_key", "kept"}
    got = {r.doc_id: r for r in rows}
    for i in (4, 5, 6):
        assert got[i].log_weight is None and got[i].kept is False
    assert abs(got[1].log_weight - got[2].log_weight) < 1e-9
    plain = quality.resample(edges, target.limit(0)).collect()
    assert all(r.kept == (r.doc_id not in (4, 5, 6)) for r in plain)
    assert quality.resample(edges.limit(0), target).collect() == []


def test_mixing_meets_targets(small, spark):
    cells = spark.createDataFrame([(s, g, t, 40 + 37 * i % 90) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in ("en", "fr") for t in "xy")], "source string, lang string, topic string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    goal = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.7, "fr": 0.3}, "topic": {"x": 0.65, "y": 0.35}}
    rows = mixing.rake(cells, {k: share(v) for k, v in goal.items()}, most=40).collect()
    for d, shares in goal.items():
        for value, s in shares.items():
            assert abs(sum(r.weight for r in rows if r[d] == value) - s) < 1e-6
    mixed = mixing.mix_sources(small, keep=0.5).collect()
    total = sum(r.mix_tokens for r in mixed)
    assert abs(sum(r.mix_tokens * r.mix_rate for r in mixed) / total - 0.5) < 0.01
    assert all(0 <= r.mix_rate <= 1 for r in mixed)


def test_mixing_edges(edges, spark):
    extra = edges.withColumn("mix_rate", edges["n_chars"]).withColumn("tokens", edges["lang"])
    rows = mixing.mix_sources(extra).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and got[2].mix_source == "unknown" and got[3].mix_lang == "unknown" and got[4].mix_tokens == 0
    assert got[7].mix_tokens == 60_000 and got[7].tokens == "en"
    assert len({r.mix_keep for r in rows if r.doc_id == 9}) == 1
    assert mixing.mix_sources(edges.limit(0)).collect() == []


def test_sentence_pieces_equal_the_library(small, edges, spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL_PATH)
    texts = [r.text for r in small.limit(60).collect()] + ["  Hello   world\n\tfoo ", "ﬁ Ａ", "a" * 50, " " * 40 + "x", " ", "日本語 漢字", "😀😀 é", "<0x41> <s>", "x" + " " * 17 + "y" * 33]
    rng = random.Random(4)
    texts += ["".join(rng.choice("ab cdeth  ein\n") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sentence_pieces.encode_pieces(df)
    for r in rows.collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids) and r.round_trip
    back = sentence_pieces.decode_pieces(rows).collect()
    assert all(r.decoded == texts[r.doc_id] for r in back)
    got = {r.doc_id: r for r in sentence_pieces.encode_pieces(edges.withColumnRenamed("n_chars", "ids")).collect()}
    assert got[4].ids is None and got[4].round_trip is None and got[5].ids == [] and got[5].round_trip
    assert got[7].round_trip and got[7].ids == library.encode(got[7].text)
    assert sentence_pieces.encode_pieces(edges.limit(0)).collect() == []


def test_unigram_viterbi_is_the_best_path():
    pieces = sentence_pieces.Pieces(sentence_pieces.UNIGRAM, True, ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "abb"], np.array([2, 1, 1, 1, 1, 1, 1, 1]), np.array([0.0, -2.0, -3.0, -3.2, -4.0, -3.5, -4.1, -7.5]))
    encoder = sentence_pieces.Encoder(pieces)
    score = dict(zip(pieces.text, pieces.score, strict=True))

    def best(word):
        if not word:
            return 0.0
        return max((score[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in score), default=-1e9)

    texts = ["abab", "abba", "bb", "aabb bab a"]
    for _, _, data, where in tb.blocks(pa.array(texts)):
        ids, at = encoder.encode(data, where)
        for i, t in enumerate(texts):
            got = [pieces.text[x] for x in ids[at[i] : at[i + 1]]]
            assert "".join(got) == "▁" + t.replace(" ", "▁")
            assert abs(sum(score[x] for x in got) - sum(best("▁" + w) for w in t.split(" "))) < 1e-9


def test_license_scan(spark, edges):
    rng = random.Random(6)
    notice = license_scan.TEMPLATES["GPL-3.0"]
    words = notice.split()
    rows = [(1, f"{prose(rng, 300)}\n{notice}\n{prose(rng, 200)}"), (2, prose(rng, 30) + " " + " ".join(words[:3] + ["quite"] + words[3:]).upper() + " end"), (3, " ".join(words[:4])), (4, f"{notice} {prose(rng, 100)} {notice}"), (5, f"the {prose(rng, 5)} license"), (6, notice), (6, notice)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "GPL-3.0"), (2, "GPL-3.0"), (4, "GPL-3.0"), (6, "GPL-3.0"), (6, "GPL-3.0")]
    by = {r.doc_id: r for r in got}
    assert (by[1].coverage, by[1].first_word, by[1].last_word, by[1].n_stretches) == (1.0, 300, 300 + 11, 1)
    assert by[2].coverage == 1.0 and by[2].last_word - by[2].first_word == 12 and by[4].n_stretches == 2
    assert license_scan.scan_licenses(edges.withColumnRenamed("lang", "license")).collect() == []
    assert license_scan.scan_licenses(edges.limit(0)).collect() == []


def test_license_scan_finds_whole_texts_and_tells_licenses_apart(spark):
    whole = {p.stem: p.read_text().replace("{", "").replace("}", "") for p in license_texts.FOLDER.glob("*.txt")}
    rng = random.Random(3)
    said = {f"{prose(rng, 40)} {text} {prose(rng, 40)}": {name} for name, text in whole.items()}
    said |= {
        "Released under the BSD License": {"BSD"},
        "Licensed under CC BY 4.0": {"CC-BY-4.0"},
        "Licensed under CC BY-SA 4.0": {"CC-BY-SA-4.0"},
        "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0"},
        "This work is licensed under the Mozilla Public License, version 2.0.": {"MPL-2.0"},
        "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-3.0"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "SPDX-License-Identifier: MIT OR Apache-2.0": {"MIT", "Apache-2.0"},
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.": {"MIT", "Apache-2.0"},
        "Released under the house License": set(),
    }
    texts = list(said)
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add(r.license)
    assert {t[:60]: got[i] for i, t in enumerate(texts)} == {t[:60]: said[t] for t in texts}
    # nothing is lost where texts are long and words repeat
    common = license_scan._common([i % 7 for i in range(300)], [i % 5 for i in range(200)], 0, 0)
    best = [[0] * 201 for _ in range(301)]
    for i in range(300):
        for j in range(200):
            best[i + 1][j + 1] = best[i][j] + 1 if i % 7 == j % 5 else max(best[i][j + 1], best[i + 1][j])
    assert len(common) == best[300][200]


def test_license_scan_equals_aligning_every_window(spark):
    """Where a stretch of the text aligns with a template as a whole, and only there, the scan has a row."""
    rng = random.Random(14)
    forms = {"A": "alpha beta gamma delta epsilon zeta eta theta iota kappa", "B": "one two three one two four five six two one seven", "-": "-- ..", "": ""}
    rows = []
    for i in range(150):
        name = rng.choice(["A", "B"])
        words = forms[name].split()
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(words) + 1)
            words[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["two"], ["kappa"]])
        rows.append((i, " ".join([prose(rng, rng.randint(0, 9)), *words, prose(rng, rng.randint(0, 9))])))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), forms).collect()}

    def common(a, b):
        last = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(last[j] + 1 if x == y else max(last[j + 1], now[-1]))
            last = now
        return last[-1]

    for i, text in rows:
        words = text.split()
        for name in "AB":
            form = forms[name].split()
            size = int(1.5 * len(form)) + 1
            best = max(common(words[s : s + size], form) for s in range(max(1, len(words) - size + 1)))
            # patience may align less than the longest common subsequence, never more; a text that has the form as it is is found
            if (i, name) in got:
                assert max(common(words[s : s + 2 * size], form) for s in range(len(words))) >= 0.8 * len(form)
            if best == len(form):
                assert (i, name) in got
    assert len(got) > 60 and license_scan.scan_licenses(spark.createDataFrame(rows[:3], "doc_id long, text string"), {"x": "--"}).collect() == []


def test_patience_alignment_is_a_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = [rng.randrange(12) for _ in range(rng.randint(0, 20))], [rng.randrange(12) for _ in range(rng.randint(0, 20))]
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and u < v for (x, u), (y, v) in zip(pairs[:-1], pairs[1:], strict=True))
    assert len(license_scan.patience(list("abcdef"), list("abXdef"))) == 5
    assert license_scan.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
