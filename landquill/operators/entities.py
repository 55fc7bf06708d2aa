"""Entities of a drawing: counts, format, radius of the stake circles, and the stakes without double entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Fixed values.
BACKGROUND = ("_f-0_", "_f-8_", "_9-0_", "_9-1_")
RADIUS = 0.25
STAKES = ("stake", "intersection_stake", "existing_stake", "restored_stake", "calculated_stake")
OWNER_LAYER = "53"


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("drawing_id", "etype").agg(F.count("*").alias("n"))


def detect_format(entities: DataFrame) -> DataFrame:
    """(drawing_id, format): 'mtext' for drawings with both MTEXT and LWPOLYLINE entities, else 'text'."""
    both = F.bool_or(F.col("etype") == "MTEXT") & F.bool_or(F.col("etype") == "LWPOLYLINE")
    return entities.groupBy("drawing_id").agg(F.when(both, "mtext").otherwise("text").alias("format"))


def modal_radius(entities: DataFrame) -> DataFrame:
    """(drawing_id, radius): the most frequent circle radius, to two places, outside background layers; ties to the first met."""
    circles = entities.where((F.col("etype") == "CIRCLE") & ~F.col("layer").isin(*BACKGROUND))
    counted = circles.groupBy("drawing_id", F.round("radius", 2).alias("r")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = counted.groupBy("drawing_id").agg(F.max_by("r", F.struct("n", -F.col("first"))).alias("radius"))
    return entities.select("drawing_id").distinct().join(best, "drawing_id", "left").select("drawing_id", F.coalesce("radius", F.lit(RADIUS)).alias("radius"))


def foreground(entities: DataFrame) -> DataFrame:
    return entities.where(~F.col("layer").isin(*BACKGROUND))


def stakes(entities: DataFrame, text_format: bool = False) -> DataFrame:
    """Circles, the first of those at the same place to three places; in the mtext format of the usual radius, in the text format of any, outside
    background layers.
    """
    circles = entities.where(F.col("etype") == "CIRCLE")
    circles = foreground(circles) if text_format else circles.where(F.abs(F.col("radius") - RADIUS) < 0.01)
    first = Window.partitionBy("drawing_id", F.round("x1", 3), F.round("y1", 3)).orderBy("ord")
    return circles.withColumn("n", F.row_number().over(first)).where("n = 1").select("drawing_id", F.col("ord").alias("stake_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), "layer")


def words(entities: DataFrame, text_format: bool = False) -> DataFrame:
    """(drawing_id, ord, x, y, layer, category, value) of MTEXT entities, or in the text format of TEXT entities outside background layers."""
    texts = foreground(entities.where(F.col("etype") == "TEXT")) if text_format else entities.where(F.col("etype") == "MTEXT")
    bare = F.trim(tx.text(F.col("text"))) if text_format else tx.clean_mtext(F.col("text"))
    return texts.select("drawing_id", "ord", F.col("x1").alias("x"), F.col("y1").alias("y"), "layer", tx.classify(F.col("text"), plain=text_format).alias("category"), tx.first_line(bare).alias("value"))


def stake_texts(entities: DataFrame, text_format: bool = False) -> DataFrame:
    """Texts that number a stake, by category."""
    return words(entities, text_format).where(F.col("category").isin(*STAKES)).withColumnRenamed("value", "number")


def boundary_lines(entities: DataFrame, text_format: bool = False) -> DataFrame:
    """(drawing_id, line_id, x1, y1, x2, y2, layer): polylines of two points, or in the text format LINE entities outside background layers."""
    lines = foreground(entities.where(F.col("etype") == "LINE")) if text_format else entities.where((F.col("etype") == "LWPOLYLINE") & (F.col("n_points") == 2))
    return lines.select("drawing_id", F.col("ord").alias("line_id"), "x1", "y1", "x2", "y2", "layer")


def owner_texts(entities: DataFrame) -> DataFrame:
    """Texts on the owners' layer that are no bare number."""
    cleaned = F.trim(tx.clean_mtext(F.col("text")))
    return entities.where((F.col("etype") == "MTEXT") & (F.col("layer") == OWNER_LAYER)).where((cleaned != "") & ~cleaned.rlike("^(?U)[\\d.-]+$")).select("drawing_id", "ord", cleaned.alias("owner"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def block_list(stakes_: DataFrame) -> DataFrame:
    """(block): the distinct block numbers of the stakes, in the order of numbers."""
    return stakes_.select(tx.block_number(F.col("number")).alias("block")).where("block is not null").distinct().orderBy(F.col("block").cast("decimal(38,0)"), "block")


def intersections_per_block(points: DataFrame) -> DataFrame:
    """(block, n) of intersections (intersection_stake)."""
    return points.select(tx.block_number(F.col("intersection_stake")).alias("block")).where("block is not null").groupBy("block").agg(F.count("*").alias("n"))


def diagnostics(stakes_: DataFrame, lines: DataFrame, labels: DataFrame, edges_of: DataFrame, public: DataFrame) -> DataFrame:
    """One row of counts: stakes (all, numbered, intersections, blocks), lines (all, with a numbered stake at both ends), labels, public lands.

    edges_of: line_id of the lines that are matched.
    """
    s = stakes_.agg(F.count("*").alias("n_stakes"), F.count("number").alias("n_named"), F.count_if(tx.is_intersection(F.col("number"))).alias("n_intersections"), F.count_distinct(tx.block_number(F.col("number"))).alias("n_blocks"))
    for df, name in ((lines, "n_lines"), (edges_of, "n_matched"), (labels, "n_labels"), (public, "n_public")):
        s = s.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return s
