"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted by cell (source, language, topic). Raking scales the cells' token weights so that their totals by
source, by language and by topic meet the target shares in turn, until a round moves less than ``TOLERANCE`` of the weight (where targets
contradict each other, the weights settle between them). A document is then kept with
the probability ``min(1, c * weight share / token share)`` of its cell; c is calibrated so that the expected kept tokens
are the wanted part of all tokens. The draw is a hash of doc_id, so that a run repeats.

Everything is windows and aggregates over the cells, of which there are as many as distinct (source, language, topic); the
documents are read twice and joined with the cells once. Null source, language or topic count as a value of their own
('unknown'). Documents without words weigh nothing and are kept with their cell's probability; a null doc_id draws as 'null'. Columns
of docs whose names start with mix_ are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

DIMENSIONS = ("source", "lang", "topic")
#: Exponents that temper the present shares into targets: 1 keeps them, 0 makes them equal.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.8}
TOLERANCE, MOST_ROUNDS, KEEP = 1e-7, 400, 0.8
ROUNDS = 2  # of raking in one job

#: Kinds of text, the first that fits: (name, a text it holds, and a regular expression, or none) or (name, least words). Spark and DuckDB
#: read both alike; the plain text spares most documents the expression.
KINDS = (
    ("table", " | ", None),
    ("licence", "icen", "(?i)licen[cs]e"),
    ("contacts", "@", "[A-Za-z0-9]@[A-Za-z0-9]"),
    ("symbols", "%%%", None),
    ("book", 2000),
    ("article", 300),
    ("piece", 60),
    ("note", 0),
)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The kind of text: what it holds (tables, licence terms, addresses, symbols), else its length."""
    out, text = F.lit(None).cast("string"), F.coalesce(text, F.lit(""))
    for name, *test in reversed(KINDS):
        fits = tokens >= test[0] if isinstance(test[0], int) else text.contains(test[0]) & (text.rlike(test[1]) if test[1] else F.lit(True))
        out = F.when(fits, name).otherwise(out)
    return out


def tempered(cells: DataFrame, temper: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Target shares (value, share) of each dimension: present token shares to the power of its exponent."""
    temper = temper or TEMPER
    out = {}
    for d in DIMENSIONS:
        total = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t")).where("t > 0").select("value", F.pow(F.col("t").cast("double"), F.lit(temper[d])).alias("p"))
        out[d] = total.crossJoin(total.agg(F.sum("p").alias("all"))).select("value", (F.col("p") / F.col("all")).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: raked in turn to each dimension's target shares until the weights stand.

    Cells of a value without a target weigh nothing. The weights sum to 1 if every dimension's targets do. Should the weights
    still move after ``most`` rounds, a warning says so.
    """
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        out = out.join(targets[d].select(F.col("value").alias(d), F.col("share").alias(f"_{d}")), d, "left").withColumn(f"_{d}", F.coalesce(f"_{d}", F.lit(0.0)))
    out = materialise(out.withColumn("_moved", F.lit(0.0)))
    for _ in range(0, most, ROUNDS):
        for _ in range(ROUNDS):
            out = out.withColumn("_moved", F.col("weight"))
            for d in DIMENSIONS:
                now = F.sum("weight").over(Window.partitionBy(d))
                out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_{d}") / now).otherwise(0.0))
        out = materialise(out.withColumn("_moved", F.abs(F.col("weight") - F.col("_moved"))))
        moved = out.agg(F.sum("_moved").alias("m")).first()["m"] or 0.0
        if moved <= tolerance:
            break
    else:
        warnings.warn(f"raking still moved {moved:.1e} of the weight after {most} rounds", stacklevel=2)
    return out.drop("_moved", *[f"_{d}" for d in DIMENSIONS])


def calibrated(weighted: DataFrame, keep: float = KEEP) -> DataFrame:
    """Cells with rate, the probability of their documents: expected kept tokens are the part keep of all tokens.

    The constant is found by solving for the cells below 1 again and again; each step can only add cells at 1, so that the steps end.
    """
    total = weighted.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w")).first()
    tokens, weight = float(total["t"] or 0), float(total["w"] or 0)
    c, n = keep * tokens / weight if weight else 0.0, -1
    while True:
        full = F.lit(c) * F.col("weight") >= F.col("tokens")
        part = weighted.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("rest")).first()
        if not part["rest"] or part["n"] == n:
            break
        c, n = (keep * tokens - float(part["full"] or 0)) / float(part["rest"]), part["n"]
    return weighted.withColumn("rate", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(c) * F.col("weight") / F.col("tokens"))))


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 hash."""
    digits = F.substring(F.md5(F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, keep: float = KEEP) -> DataFrame:
    """docs with mix_source, mix_lang, mix_topic, mix_tokens, mix_rate and mix_keep.

    docs: doc_id, text, source, lang and any others. targets: shares (value, share) by dimension, else tempered ones. topic: a
    column of docs' own topics; else the kind of text stands for it.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    counted = docs.withColumns({"mix_source": F.coalesce("source", F.lit("unknown")), "mix_lang": F.coalesce("lang", F.lit("unknown")), "mix_tokens": token_count(F.col("text"))})
    known = counted.withColumn("mix_topic", F.coalesce(topic if topic is not None else topic_of(F.col("text"), F.col("mix_tokens")), F.lit("unknown")))
    cells = materialise(known.groupBy(F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens")))
    rates = calibrated(rake(cells, targets or tempered(cells)), keep)
    rates = cells.join(rates.select(*DIMENSIONS, "rate"), list(DIMENSIONS), "left").select(*[F.col(d).alias(f"mix_{d}") for d in DIMENSIONS], F.coalesce("rate", F.lit(keep)).alias("mix_rate"))
    out = known.join(materialise(rates), [f"mix_{d}" for d in DIMENSIONS]).withColumn("mix_keep", draw(F.col("doc_id")) < F.col("mix_rate"))
    return out.select(*docs.columns, *[f"mix_{d}" for d in DIMENSIONS], "mix_tokens", "mix_rate", "mix_keep")


def oracle_sql(tolerance: float = TOLERANCE, most: int = MOST_ROUNDS, keep: float = KEEP) -> str:
    """DuckDB SQL for the rows of the registered query: the rounds are a recursive table, the constant comes from sums in order of saturation."""
    words = "len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))"
    holds = lambda part, test: f"contains(coalesce(text, ''), '{part}')" + (f" and regexp_matches(coalesce(text, ''), '{test}')" if test else "")
    kinds = " ".join(f"when tokens >= {test[0]} then '{name}'" if isinstance(test[0], int) else f"when {holds(*test)} then '{name}'" for name, *test in KINDS)
    round_ = "(select *, weight as old from {0})"
    for dim in DIMENSIONS:
        round_ = f"(select * replace (coalesce(weight * _{dim} / nullif(sum(weight) over (partition by {dim}), 0), 0) as weight) from {round_})"
    steps = f"(select * exclude (old), abs(weight - old) as moved from {round_})"
    both = "r"
    for _ in range(ROUNDS):
        both = steps.format(f"(select * exclude (moved) from {both})")
    shares = " ".join(f"join (select {dim}, pow(sum(tokens)::double, {TEMPER[dim]}) / sum(pow(sum(tokens)::double, {TEMPER[dim]})) over () as _{dim} from c group by {dim} having sum(tokens) > 0) using ({dim})" for dim in DIMENSIONS)
    draw_sql = f"('0x' || substr(md5('mix-' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / {float(1 << 52)}"
    return f"""with recursive n as (select doc_id, text, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, {words} as tokens from documents),
d as (select doc_id, source, lang, case {kinds} end as topic, tokens from n),
c as (select source, lang, topic, sum(tokens)::bigint as tokens from d group by all),
w as (select *, tokens::double as weight, 0::double as moved from c {shares} where tokens > 0),
r as (select 0 as k, 1::double as total, * from w union all select k + {ROUNDS}, sum(moved) over (), * exclude (k, total) from {both} where k < {most} and total > {tolerance}),
f as materialized (select source, lang, topic, tokens, weight from r where k = (select max(k) from r)),
s as (select *, sum(tokens) over o - tokens as below, sum(weight) over () - (sum(weight) over o - weight) as above, sum(tokens) over () as every from f where weight > 0 window o as (order by tokens / weight, source, lang, topic)),
g as (select coalesce(max(({keep} * every - below) / above) filter (({keep} * every - below) / above < tokens / weight), 'inf'::double) as c from s),
q as (select source, lang, topic, least(1.0, greatest(0.0, case when weight > 0 then c * weight / tokens else 0 end)) as rate from f, g)
select doc_id, source, lang, topic, tokens::bigint as n_tokens, round(coalesce(rate, {keep}), 6) as rate, {draw_sql} < coalesce(rate, {keep}) as kept from d left join q using (source, lang, topic)"""
