"""From raw documents to token ids: the stages of a training corpus, each written as Parquet and read again by the next.

1. quality: documents that importance resampling rejects go.
2. line_dedup: lines that occur earlier, or nearly do, go, those of fewer than 24 characters if they are in ``SHORT_LINE_DOCS``
   documents or more; a document that lost lines and has only blank ones left goes
   with them.
3. ngram_join: of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays. Where rows
   share a doc_id, each is judged by its own text.
4. mixing: documents are sampled by calibrated probabilities, so that the rest meets target shares of tokens.
5. sentence_pieces: texts become ids of a public SentencePiece model.

A null doc_id or text passes 2 and 3 unchanged; documents without words go in 1.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landquill.llm import line_dedup, mixing, quality, sentence_pieces
from landquill.llm.ngram_join import ngram_components
from landquill.llm.shared import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.resample(docs, good).where("kept").select(*docs.columns)


#: Short lines that few documents share (headings, one-word lines) stay.
SHORT_LINE_DOCS = 5


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, exact_chars=line_dedup.EXACT_CHARS, exact_docs=SHORT_LINE_DOCS).where((F.col("n_dropped") == 0) | F.col("text").rlike("\\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = ngram_components(docs, k=5, similarity=(80, 100)).where("doc_id <> component_id").select(F.col("doc_id").alias("_nj_id"), F.col("text_key").alias("_nj_key")).distinct()
    return docs.join(copies, (F.col("doc_id") == F.col("_nj_id")) & (F.xxhash64("text") == F.col("_nj_key")), "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).where("mix_keep").select(*docs.columns)


def sentence_pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_pieces(docs).drop("text")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("mixing", mixing_stage),
    ("sentence_pieces", sentence_pieces_stage),
]

#: SQL cannot express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, through written tables in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
