"""The registered queries of the llm operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, mixing, packing, prefix_trie, quality
from .language_id import identify
from .license_scan import scan_licenses
from .line_dedup import EXACT_CHARS, dedup_lines
from .ngram_join import ngram_components
from .sentence_pieces import encode_pieces
from .shared import materialise, table
from .url_rules import LISTED, host_of, judge_urls, labelled_urls, listed_rule, path_of
from .vectors import linked_vectors, nearest


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_rate", 6).alias("rate"), F.col("mix_keep").alias("kept"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    out = quality.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), good)
    return out.select("doc_id", "n_ngrams", "log_weight", "gumbel_key", "kept")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=EXACT_CHARS)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, similarity=(90, 100))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, places = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    total = places.agg(F.expr("try_cast(sum(cast(inertia as decimal(38, 0))) as bigint)").alias("inertia"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")).cast("binary"), 256)
    named = places.crossJoin(total.withColumnRenamed("inertia", "all_inertia")).select("cluster", F.col("inertia").alias("cluster_inertia"), F.col("all_inertia").alias("inertia"), digest.alias("centroid_sha256"))
    return members.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # 40 rows


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_document_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.document_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digests = materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").withColumn("no", F.monotonically_increasing_id()))
    return digests.join(packing.pack(digests), "no").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def url_listed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op10_url_filter that SQL can express: host, path, and the listed rule with its verdict."""
    parts = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"))
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed_verdict"))


_FITS = " union all ".join(f"select '{h}' as h, '{p}' as p, '{v}' as v" for h, p, v in LISTED)
_LISTED_SQL = f"""with l as ({_FITS}),
u as (select page_id, case when contains(url, '://') then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
  case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path from pages),
f as (select page_id, host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as listed_verdict from u join l on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select u.page_id, u.host, u.path, f.rule, f.listed_verdict from u left join f on f.page_id = u.page_id and f.host = u.host and f.path = u.path"""

QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_language_id, op3_approximate_neighbours, op4_embedding_near_dedup, op5_quality_classifier, op6_sentence_pieces, op7_line_dedup, op8_ngram_jaccard_join, op9_license_scan, op10_url_filter, op11_centroid_clusters, op12_conversation_trie, op13_document_packing, url_listed_rules)}
ORACLE_SQL = {"op1_source_mixing": mixing.oracle_sql(), "op11_centroid_clusters": centroids.oracle_sql(), "op12_conversation_trie": prefix_trie.oracle_sql(), "url_listed_rules": _LISTED_SQL}
