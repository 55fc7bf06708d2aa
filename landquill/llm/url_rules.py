"""URL filter: listed host and path rules first, then association rules that FP-growth mines from labelled URLs.

A URL becomes a set of tokens (host parts, path parts with digits folded, names of query parameters). FP-growth counts the
token combinations of labelled URLs; a combination becomes a rule when enough URLs to be blocked hold it (support), their part of all
that hold it (confidence) is ``min_lift`` times their part of all URLs and, by the lower end of its interval (``z`` deviations),
above that part at least, and no smaller combination inside it does as well. All such rules count. Up to ``max_rules`` of them are matched by an inverted index from tokens to rules that travels as a literal, so that
judging a page is a projection: no shuffle, no Python; more are joined with the pages' tokens by their rarest token.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are allowed. Repeated rows are judged alike;
further columns are ignored; a URL of any length is split whole, labelled or not: tokens that the same labelled URLs hold are one item of
FP-growth, so that the parts that only one URL or one template has do not multiply. Without labels, or with labels of one kind, no rule is mined.
"""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "=blocked"

#: (host, path, verdict) of the listed rules.
LISTED = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; empty for null."""
    digits = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    part = lambda text, by, tag: F.transform(F.filter(F.split(text, by), lambda x: x != ""), lambda x: F.concat(F.lit(tag), digits(x)))
    query = F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("?"), digits(F.element_at(F.split(x, "="), 1))))
    tokens = F.concat(part(host_of(url), "\\.", "."), part(path_of(url), "/", "/"), names)
    return F.coalesce(F.array_distinct(tokens), F.array().cast("array<string>"))


def listed_rule(host: Column, path: Column, rules: tuple = LISTED) -> tuple[Column, Column]:
    """(rule text or null, its verdict or null) of the longest listed rule that fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def lower_end(share: Column, n: Column, z: float) -> Column:
    """Lower end of Wilson's interval of a share of n."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def alike_tokens(baskets: DataFrame) -> DataFrame:
    """(token, rep): each token of baskets (row, tokens), and the smallest of those that the same rows hold.

    Sets of rows are told apart by their number and 128 bits of hashes. However long a URL is, the tokens that only it holds are one.
    """
    held = baskets.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(7))).alias("b"))
    first = held.groupBy("n", "a", "b").agg(F.min("token").alias("rep"))
    return held.join(first, ["n", "a", "b"]).select("token", "rep")


def minimal_rules(labelled: DataFrame, min_support: float = 0.002, min_lift: float = 1.25, z: float = 1.645) -> DataFrame:
    """(tokens, alike, confidence, support, rarest) of the rules for blocking; labelled: url, blocked (boolean).

    No smaller combination inside a rule is as sure. A combination with two tokens that the same URLs hold is as sure without one of them, so that no
    rule has both; FP-growth gets one item for all such tokens. A rule's tokens are the first of each such class, alike (array of arrays) all of
    each: the rule is that of every choice of one token from each. rarest is the token that the fewest labelled URLs hold.
    """
    rows = labelled.where("blocked is not null").select("blocked", url_tokens(F.col("url")).alias("tokens")).where("blocked or size(tokens) > 0").withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows)
    names = materialise(alike_tokens(rows))
    merged = rows.select("row", F.explode("tokens").alias("token")).join(names, "token").groupBy("row").agg(F.collect_set("rep").alias("reps"))
    items = F.coalesce("reps", F.array().cast("array<string>"))
    baskets = rows.join(merged, "row", "left").select(F.when(F.col("blocked"), F.array_append(items, F.lit(BLOCKED))).otherwise(items).alias("items"))
    sums = baskets.agg(F.count("*").alias("n"), F.count_if(F.array_contains("items", BLOCKED)).alias("blocked")).first()
    total = sums["n"]
    if not sums["blocked"]:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, alike array<array<string>>, confidence double, support double, rarest string")
    base = sums["blocked"] / total
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets
    keyed = sets.select(F.array_sort(F.array_remove("items", BLOCKED)).alias("tokens"), F.array_contains("items", BLOCKED).alias("with"), "freq")
    rated = keyed.groupBy("tokens").agg(F.max(F.when(F.col("with"), F.col("freq"))).alias("hits"), F.max(F.when(~F.col("with"), F.col("freq"))).alias("all"))
    rated = rated.where((F.size("tokens") > 0) & (F.col("hits") > 0)).withColumn("n", F.size("tokens"))
    rated = materialise(rated.select("tokens", "n", "all", (F.col("hits") / F.col("all")).alias("confidence"), (F.col("hits") / F.lit(total)).alias("support")))
    # every part of a set is a set of the table too: the surest part of each, size by size
    level = rated.where("n = 1").select("tokens", "confidence", F.lit(None).cast("double").alias("below"))
    levels = [level]
    for n in range(2, (rated.agg(F.max("n")).first()[0] or 0) + 1):
        parts = rated.where(F.col("n") == n).select("tokens", "confidence", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.filter("tokens", lambda _, j: j != i))).alias("part"))
        surest = level.select(F.col("tokens").alias("part"), F.greatest("confidence", "below").alias("sure"))
        level = materialise(parts.join(surest, "part").groupBy("tokens", "confidence").agg(F.max("sure").alias("below")))
        levels.append(level)
    best = reduce(DataFrame.union, levels).where(F.col("below").isNull() | (F.col("below") < F.col("confidence"))).select("tokens")
    sure = (F.col("confidence") >= min_lift * base) & (lower_end(F.col("confidence"), F.col("all"), z) > base)
    kept = best.join(rated.where(sure).select("tokens"), "tokens")
    single = rated.where("n = 1").select(F.col("tokens")[0].alias("token"), "all")
    rules = kept.join(rated.select("tokens", "confidence", "support"), "tokens")
    classes = names.groupBy(F.col("rep").alias("token")).agg(F.array_sort(F.collect_list("token")).alias("same"))
    each = rules.select("tokens", F.posexplode("tokens").alias("at", "token")).join(single, "token").join(classes, "token")
    rarest = each.groupBy("tokens").agg(F.min_by("token", F.struct("all", "token")).alias("rarest"), F.array_sort(F.collect_list(F.struct("at", "same"))).alias("c"))
    return materialise(rules.join(rarest, "tokens").select("tokens", F.transform("c", lambda x: x["same"]).alias("alike"), "confidence", "support", "rarest"))


def _best_first(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), "tokens")


def mine_rules(labelled: DataFrame, **mining) -> list[tuple[list[str], float, float]]:
    """(tokens, confidence, support) of all minimal rules, best first, with every choice of tokens that are alike written out."""
    return [(list(t), float(r["confidence"]), float(r["support"])) for r in _best_first(minimal_rules(labelled, **mining)).collect() for t in itertools.product(*r["alike"])]


def matched_rule(tokens: Column, rules: list[tuple[list[list[str]], float]]) -> Column:
    """Number of the first rule of which a token of each class is present, else null, by an inverted index over the classes.

    rules: (classes of tokens, confidence); classes are the same or have no token in common.
    """
    if not rules:
        return F.lit(None).cast("int")
    names: dict[str, int] = {}
    index: dict[int, list[int]] = {}
    for i, (classes, _) in enumerate(rules):
        for same in classes:
            k = names.setdefault(same[0], len(set(names.values())))
            names.update(dict.fromkeys(same, k))
            index.setdefault(k, []).append(i)
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    where, rules_of = literal(names, "map<string,int>"), literal([index[k] for k in range(len(index))], "array<array<int>>")
    size = F.array(*[F.lit(len(c)) for c, _ in rules])
    classes = F.array_distinct(F.transform(F.filter(tokens, lambda t: F.map_contains_key(where, t)), lambda t: F.element_at(where, t)))
    hits = F.flatten(F.transform(classes, lambda k: F.get(rules_of, k)))
    whole = F.filter(F.array_distinct(hits), lambda r: F.size(F.filter(hits, lambda x: x == r)) == F.get(size, r))
    return F.array_min(whole)


def _joined_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with _tokens) and mined_rule, confidence: as by matched_rule, by joins with the table of rules."""
    placed = materialise(_best_first(rules).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    before, offset = 0, F.lit(0)
    for r in placed.groupBy("part").agg(F.min("at").alias("least"), F.count("*").alias("n")).orderBy("part").collect():
        offset = F.when(F.col("part") == r["part"], F.lit(before - r["least"])).otherwise(offset)
        before += r["n"]
    numbered = placed.select("tokens", "confidence", "rarest", (F.col("at") + offset).cast("int").alias("mined_rule"))
    names = placed.select(F.explode(F.arrays_zip(F.col("tokens").alias("rep"), F.col("alike").alias("same"))).alias("c")).select(F.explode("c.same").alias("token"), F.col("c.rep").alias("rep")).distinct()
    asked = pages.select("_tokens").distinct()
    reps = asked.select("_tokens", F.explode("_tokens").alias("token")).join(names, "token").groupBy("_tokens").agg(F.collect_set("rep").alias("reps"))
    held = reps.withColumn("rarest", F.explode("reps")).join(numbered, "rarest").where(F.size(F.array_except("tokens", "reps")) == 0)
    first = held.groupBy("_tokens").agg(F.min(F.struct("mined_rule", "confidence")).alias("r")).select("_tokens", "r.*")
    return pages.join(first, "_tokens", "left")


def judge_urls(pages: DataFrame, labelled: DataFrame, listed: tuple = LISTED, max_rules: int = 500, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule's number and confidence, for every row of pages (page_id, url)."""
    table = minimal_rules(labelled, **mining)
    url = F.col("url")
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    size = table.agg(F.count("*").alias("rules"), F.sum(F.size(F.flatten("alike"))).alias("tokens")).first()
    if size["rules"] > max_rules or (size["tokens"] or 0) > 20 * max_rules:
        out = _joined_rule(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("_tokens")), table)
    else:
        rules = [([list(c) for c in r["alike"]], float(r["confidence"])) for r in _best_first(table).collect()]
        number = matched_rule(url_tokens(url), rules)
        sure = F.get(F.array(*[F.lit(c) for _, c in rules]), F.col("mined_rule")) if rules else F.lit(None).cast("double")
        out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), number.alias("mined_rule")).withColumn("confidence", sure)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule", "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages whose URL names a labelled document by its number: those of low quality are to be blocked."""
    known = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("blocked"))
    number = F.expr("try_cast(regexp_extract(url, '://[^/?#]*[^?#]*/([0-9]+)', 1) as bigint)")
    return pages.select("url", number.alias("doc_id")).where("doc_id is not null").join(known, "doc_id").select("url", "blocked")
