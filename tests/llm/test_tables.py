"""URL rules, embeddings, the pipeline and the registered queries."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landquill.llm import queries, url_rules, vectors
from landquill.llm.shared import components, materialise

from .test_text_operators import SF, brute_components, brute_lines


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (5, None)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in list(root)}


def test_url_rules_and_mined_rules(spark):
    listed = [("https://a.com", "a.com", "", None, "allow"), ("http://X.Com/en/1?q=/fr/", "x.com", "/en/1", "com/", "allow"), ("https://example.com/en/2", "example.com", "/en/2", "example.com/en/", "block"), ("https://b.www.EXAMPLE.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"), ("s://shop.net/fr/x#a", "shop.net", "/fr/x", "net/fr/", "block"), ("s://shopnet/fr/x", "shopnet", "/fr/x", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://h?y://z/p", "h", "", None, "allow")]
    pages = spark.createDataFrame([(i, r[0], 1) for i, r in enumerate(listed)] + [(0, listed[0][0], 1)], "page_id long, url string, host int")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = url_rules.judge_urls(pages, none).collect()
    assert len(got) == len(listed) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == listed[r.page_id][1:]

    rng = random.Random(3)
    rows = []
    for i in range(600):
        spam = rng.random() < 0.4
        rows.append((f"http://h{i % 5}.org/{'promo' if spam else 'news'}/{i}?{'utm' if rng.random() < 0.5 else 'id'}={i}", spam if rng.random() < 0.95 else not spam))
    rows += [(None, True), ("http://h1.org/promo/1", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = url_rules.mine_rules(labelled)
    assert (["/promo"], True) in [(t, c > 0.85) for t, c, _ in rules]
    baskets = [(set(spark.createDataFrame([(u,)], "url string").select(url_rules.url_tokens(url_rules.F.col("url"))).first()[0]), b) for u, b in rows[:40]]
    assert all("/promo" in t or "/news" in t for t, _ in baskets)
    for tokens, confidence, support in rules:
        held = [b for u, b in rows if u is not None and b is not None and all((t[1:] in u) for t in tokens)]
        assert len(held) * confidence > 0 and support > 0 and confidence >= 1.25 * sum(bool(b) for u, b in rows if u) / len(rows)
    asked = spark.createDataFrame([(1, "http://z.org/promo/5"), (2, "http://z.org/news/5")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge_urls(asked, labelled).collect()} == {1: "block", 2: "allow"}
    assert url_rules.judge_urls(asked.limit(0), none).collect() == []


def test_all_minimal_rules_count(spark):
    rows = []
    for host in "abcdefghijkl":
        rows += [(f"http://{host}site.{host}tld/{host}x/{host}y/{host}z?{host}q={i}", True) for i in range(30)]
    rows += [(f"http://n{i}.org/promo/{i}", i % 10 < 7) for i in range(60)]
    rows += [(f"http://n{i}.org/news/{i}", False) for i in range(1000)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = url_rules.mine_rules(labelled)
    singles = {f"{tag}{host}{end}" for host in "abcdefghijkl" for tag, end in ((".", "site"), (".", "tld"), ("/", "x"), ("/", "y"), ("/", "z"), ("?", "q"))}
    assert sorted(t for t, c, _ in rules) == sorted([[x] for x in singles] + [["/promo"]]) and rules[-1][:2] == (["/promo"], 0.7)
    pages = spark.createDataFrame([(1, "http://z.org/promo/5"), (2, "http://z.org/news/5"), (3, "http://lsite.com/"), (3, "http://lsite.com/"), (4, None), (None, "http://z.org/bx/ay")], "page_id long, url string")
    got = sorted(map(str, url_rules.judge_urls(pages, labelled).collect()))
    assert [r.verdict for r in url_rules.judge_urls(pages.where("page_id = 1"), labelled).collect()] == ["block"]
    assert sorted(map(str, url_rules.judge_urls(pages, labelled, max_rules=10).collect())) == got and len(got) == 6


xx = F.xxhash64
VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.1, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3) if i % 50 else None))
    rows += [(1000 + i, rows[20][1], 1) for i in range(60)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2020, [], 1), (None, rows[5][1], 1), (2040, [1.0, 2.0], 1), (3, rows[3][1], 0)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vector_rows(), VECTORS)


def usable():
    return {i: (np.array(v, np.float64), k) for i, v, k in vector_rows() if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}


def test_links_equal_brute_force(table, monkeypatch):
    rows = usable()
    ids = sorted(i for i, (_, k) in rows.items() if k is not None and len(rows[i][0]) == 16)
    x = np.array([rows[i][0] / np.linalg.norm(rows[i][0]) for i in ids])
    label = np.array([rows[i][1] for i in ids])
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.minimum(comp, np.where(link, comp[None, :], len(ids)).min(1))
        if (new == comp).all():
            break
        comp = new
    want = {i: (int(n), ids[c]) for i, n, c in zip(ids, link.sum(1), comp, strict=True)}
    for block in (4096, 16):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
        out = vectors.linked_vectors(table.withColumn("n", table["vec_id"])).collect()
        assert len(out) == len(vector_rows())
        for r in out:
            n, c = want.get(r.vec_id, (0, r.vec_id))
            assert (r.n_links, r.component_id) == (n, c), r
            assert r.kept == (r.vec_id is None or c == r.vec_id)


def test_labels_with_equal_hashes_do_not_link(table, monkeypatch):
    rows = table.where("label is not null").withColumn("label", F.concat(F.lit("k"), F.col("label").cast("string")))
    want = sorted(map(str, vectors.linked_vectors(rows).collect()))
    monkeypatch.setattr(vectors.F, "xxhash64", lambda *c: F.lit(5).cast("long") if c == ("label",) else xx(*c))
    assert sorted(map(str, vectors.linked_vectors(rows).collect())) == want


def test_nearest_recall_and_ties(table, monkeypatch):
    rows = usable()
    for block in (4096, 32):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
        got = {}
        for r in vectors.nearest(table).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        hits = total = 0
        for q in (i for i in rows if i % 20 == 0):
            others = [i for i in rows if i != q and len(rows[i][0]) == len(rows[q][0])]
            want = sorted(others, key=lambda i: (-float(rows[q][0] @ rows[i][0]), i))[:20]
            mine = sorted(got.get(q, []))
            assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
            assert all(abs(s - float(rows[q][0] @ rows[i][0])) < 1e-9 for _, i, s in mine)
            hits, total = hits + len({i for _, i, _ in mine} & set(want)), total + len(want)
            if q == 1000:  # a group of equal vectors: the smallest ids of the copies
                assert [i for _, i, _ in mine] == want
        assert hits / total >= 0.9
    assert 2020 not in got and 2000 not in got


def test_vector_edges(spark, table):
    assert vectors.nearest(table.limit(0)).collect() == []
    assert vectors.linked_vectors(table.limit(0)).collect() == []
    few = spark.createDataFrame([(20, [1.0, 0.0], 1), (21, [0.5, 0.5], 1), (22, [0.5, 0.5], None)], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id) for r in vectors.nearest(few).orderBy("rank").collect()] == [(20, 1, 21), (20, 2, 22)]


def test_fast_hadamard():
    x = np.random.default_rng(0).normal(size=(5, 16))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)])
    assert np.allclose(vectors.hadamard(x), x @ h)


def test_pipeline_stages_against_brute_force(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = materialise(spark.read.parquet(f"{SF}/documents.parquet").limit(80))
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "ngram_join", "mixing", "sentence_pieces"]
    stage = dict(corpus_pipeline.STAGES)
    kept = materialise(stage["quality"](spark, docs, SF))
    assert kept.columns == columns and 0 < kept.count() <= 80
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in docs.collect()}
    left = {r.doc_id for r in kept.collect()}
    assert len(good & left) >= 0.95 * len(good) and len(bad & left) <= 0.5 * len(bad & {r.doc_id for r in docs.collect()}) + 1
    lines = materialise(stage["line_dedup"](spark, kept, SF))
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()], 2, 24)
    before = {r.doc_id: r.text for r in kept.collect()}
    want = {i: t for i, t in want.items() if t == before[i] or any(len(x) >= 24 for x in t.split("\n"))}
    assert {r.doc_id: r.text for r in lines.collect()} == want and lines.columns == columns
    single = materialise(stage["ngram_join"](spark, lines, SF))
    comps = brute_components([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in comps.items() if c == i} and single.columns == columns
    mixed = materialise(stage["mixing"](spark, single, SF))
    assert mixed.columns == columns and 0 < mixed.count() < single.count()
    coded = stage["sentence_pieces"](spark, mixed, SF).collect()
    assert len(coded) == mixed.count() and all(r.round_trip for r in coded)
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).collect() == [], name


def test_the_whole_pipeline_equals_a_plain_version(spark):
    """run() over all of the smallest tables, stage by stage in plain Python (mixing by its SQL, pieces by the library)."""
    import hashlib

    import pandas as pd
    import sentencepiece

    from landquill.llm import quality, sentence_pieces
    from landquill.llm import textblocks as tb

    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    grams = {}
    for i, r in docs.items():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        word, at = tb.words(data, np.array([0, len(data)]))
        grams[i] = (np.concatenate((word, tb.shingles(word, at, 2)[0])) >> np.uint64(64 - quality.BITS)).astype(np.int64)
    count = lambda ids: np.bincount(np.concatenate([grams[i] for i in ids]), minlength=quality.BUCKETS)
    raw, want = count(docs), count(good & docs.keys())
    ratio = np.log((want + 1) / (want.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    weight = {i: float(ratio[g].sum()) for i, g in grams.items() if len(g)}
    noise = lambda i: -np.log(-np.log((int(hashlib.md5(f"quality-0-{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52))
    edge = np.quantile([weight[i] for i in good if i in weight], quality.LOSS)
    k = sum(w >= edge - 1e-9 for w in weight.values())
    kept = sorted(weight, key=lambda i: (-(weight[i] + noise(i)), i))[:k]

    rows = [(i, docs[i].text) for i in kept]
    least, holders, place = corpus_pipeline.line_dedup.EXACT_CHARS, {}, {}
    for i, t in sorted(rows):
        for n, line in enumerate(t.split("\n")):
            if len(line) < 24 and len(line.strip(" \t\r")) >= least:
                holders.setdefault(line, set()).add(i)
                place.setdefault(line, (i, n))
    texts = {}
    long = brute_lines(rows, 2, 24, gone=(gone := set()))
    for i, t in rows:
        lines = t.split("\n")
        stays = [x for n, x in enumerate(lines) if (i, n) not in gone and not (len(holders.get(x, ())) >= corpus_pipeline.SHORT_LINE_DOCS and place[x] != (i, n))]
        if len(stays) == len(lines) or any(x.strip() for x in stays):
            texts[i] = "\n".join(stays)
    assert long.keys() == dict(rows).keys()
    texts = {i: texts[i] for i, (_, c) in brute_components(list(texts.items()), 5, 80).items() if c == i}
    con = duckdb.connect()
    documents = pd.DataFrame([(i, t, docs[i].source, docs[i].lang) for i, t in texts.items()], columns=["doc_id", "text", "source", "lang"]).astype({"doc_id": "int64"})
    con.register("documents", documents)
    mixed = {r[0] for r in con.execute(f"select doc_id, kept from ({queries.ORACLE_SQL['op1_source_mixing']})").fetchall() if r[1]}
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL_PATH)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == mixed and len(out) == len(mixed) > 50
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip for r in out)


def test_line_dedup_stage_keeps_documents_with_short_lines_left(spark):
    shared = ["A header that many documents have.", "A footer that many documents have."]
    rows = [(1, "\n".join(shared)), (2, "\n".join([shared[0], "roses are red", "violets", shared[1]])), (3, "\n".join([shared[0], " ", "", shared[1]])), (4, None), (5, ""), (6, "short")]
    out = corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "roses are red\nviolets", 4: None, 5: "", 6: "short"}


def test_short_repeated_lines_go(spark, tmp_path):
    own = [f"A line of its own, number {i} of these, {'abcdefgh'[i] * 9}." for i in range(8)]
    rows = [(i, "\n".join([own[i], "All rights reserved.", "}", "", "  \t  ", "end", "in two" if i < 2 else "x"])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = lambda i, short: "\n".join([own[i], *short, "}", "", "  \t  ", "end"])
    got = {r.doc_id: r.text for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: left(i, ["All rights reserved."] if i == 0 else []) + ("\nin two" if i == 0 else "" if i == 1 else "\nx") for i in range(8)}
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, SF).collect()}
    assert got == {i: left(i, ["All rights reserved."] if i == 0 else []) + ("\nin two" if i < 2 else "\nx") for i in range(8)}


def test_rules_equal_plain_counting(spark):
    """Mining and matching against all combinations of tokens, counted one by one."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        host = rng.choice(["a", "b", "c", "casino"])
        path = rng.choice(["x", "y", "buy"])
        rows.append((f"http://{host}.org/{path}/{i}", rng.random() < (0.7 if host == "casino" and path == "buy" else 0.5 if path == "buy" else 0.15)))
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    sets = [(frozenset(t), b) for t, b in labelled.select(url_rules.url_tokens(url_rules.F.col("url")), "blocked").collect()]
    base, total = sum(b for _, b in sets) / len(sets), len(sets)
    counts = {}
    for t, b in sets:
        for n in range(1, len(t) + 1):
            for part in itertools.combinations(sorted(t), n):
                c = counts.setdefault(frozenset(part), [0, 0])
                c[0] += 1
                c[1] += b
    frequent = {s: (h / n, n, h) for s, (n, h) in counts.items() if h >= 0.01 * total}
    z = 1.645
    end = lambda p, n: (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    want = {s: (p, h / total) for s, (p, n, h) in frequent.items() if p >= 1.25 * base and end(p, n) > base and all(frequent[q][0] < p for q in frequent if q < s)}
    got = {frozenset(t): (c, s) for t, c, s in url_rules.mine_rules(labelled, min_support=0.01)}
    assert got.keys() == want.keys() and len(want) > 1 and all(abs(got[s][i] - want[s][i]) < 1e-12 for s in want for i in (0, 1))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[:60])] + [(900, "http://q.org/" + "buy/" * 5000)], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labelled, min_support=0.01).collect()}
    assert all(verdicts[i] == ("block" if any(s <= sets[i][0] for s in want) else "allow") for i in range(60)) and 900 in verdicts


def test_long_labelled_urls_and_templates(spark):
    """Tokens that only one URL, or one template, has do not multiply; with the registered defaults, equal to plain counting."""
    rng = random.Random(4)
    rows = [(f"http://h{'abc'[i % 3]}.org/{rng.choice('xy')}/{i}", rng.random() < 0.12) for i in range(40)] + [("http://q.org/" + "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)), True)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = url_rules.minimal_rules(labelled).collect()
    assert sorted(len(c) for r in rules for c in r.alike)[-1] >= 200
    sets = [(frozenset(t), b) for t, b in labelled.select(url_rules.url_tokens(url_rules.F.col("url")), "blocked").collect()]
    every = {t for s, _ in sets for t in s}
    base, z = sum(b for _, b in sets) / len(sets), 1.645
    end = lambda p, n: (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    def rate(part):
        held = [b for s, b in sets if part <= s]
        return (sum(held) / len(held), len(held)) if held else (0, 0)

    want = set()
    single = {t: rate(frozenset([t])) for t in every}
    for t, (p, n) in single.items():
        if p >= 1.25 * base and p and end(p, n) > base:
            want.add(frozenset([t]))
    got = {frozenset(t) for t, _, _ in url_rules.mine_rules(labelled)}
    assert {g for g in got if len(g) == 1} == want
    for g in got - want:
        p, n = rate(g)
        assert p >= 1.25 * base and end(p, n) > base and all(rate(g - {t})[0] < p for t in g)
    asked = spark.createDataFrame([(1, "http://new.org/partcc/z"), (2, "http://new.org/z")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge_urls(asked, labelled).collect()} == {1: "block", 2: "allow"} == {r.page_id: r.verdict for r in url_rules.judge_urls(asked, labelled, max_rules=0).collect()}
    deep = "/".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    template = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit(f"http://deep.net/{deep}/"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("http://n.org/"), F.col("id").cast("string"))).alias("url"), (F.col("id") % 100 == 0).alias("blocked"))
    assert [len(r.alike[0]) for r in url_rules.minimal_rules(template).collect()] == [62]


def test_listed_rules_equal_their_sql(spark):
    got = sorted(map(tuple, queries.url_listed_rules(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["url_listed_rules"])
    assert [d[0] for d in want.description] == ["page_id", "host", "path", "rule", "listed_verdict"]
    assert str(got) == str(sorted(want.fetchall()))


def test_nearest_recall_on_the_embeddings(spark):
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.embedding]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in queries.op3_approximate_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[: min(20, len(ids) - 1)]].tolist())
        hits, total = hits + len(want & got[int(ids[q])]), total + len(want)
    assert hits >= 0.9 * total


def test_mixing_query_equals_its_sql(spark):
    got = sorted(tuple(r) for r in queries.op1_source_mixing(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op1_source_mixing"]).fetchall())
    assert [r[:5] + r[6:] for r in got] == [r[:5] + r[6:] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-6 for a, b in zip(got, want, strict=True))
