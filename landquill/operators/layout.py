"""Report cells as tables: which value stands on which sheet, row and column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import block_number, natural_key

# fixed places of the forms
RING_PAGE, RING_COLUMN, RING_ROW, RING_COLUMNS = 100, 25, 5, (1, 4, 7, 10)
POINTS_PAGE, POINTS_ACROSS, COLUMN_STEP = 15, 3, 18
CENTRE_ROWS = (10, 21, 32, 43, 54)
POINT_CELLS = (("extension_point1", -5, 11), ("extension_point2", -2, 11), ("baseline_point1", 2, 2), ("intersection_stake", 2, 8), ("baseline_point2", 2, 14))


def modal_block(ring: Column) -> Column:
    """The most frequent block number of a ring's stakes; on ties the first met. A closing stake counts twice."""
    return _modal(_blocks(ring))


def _blocks(ring: Column) -> Column:
    return F.array_compact(F.transform(ring, block_number))


def _modal(blocks: Column) -> Column:
    """The most frequent of blocks, a column: the lambda would make an expression anew for each block."""
    scored = F.transform(F.array_distinct(blocks), lambda b: F.struct(F.size(F.filter(blocks, lambda x: x == b)).alias("n"), (-F.array_position(blocks, b)).alias("first"), b.alias("block")))
    return F.array_max(scored)["block"]


def in_parcel_order(rows: DataFrame, number: Column, *then: str | Column) -> DataFrame:
    """rows with _key (see natural_key) in the natural order of parcel numbers; other texts come last. Ties go by then.

    The key is a column before it is sorted by: a sort makes expressions anew for each comparison.
    """
    return rows.withColumn("_key", natural_key(number)).orderBy(F.col("_key").isNull(), "_key", *then)


def preview(rows: DataFrame, number: str, order: str, most: int = 80) -> DataFrame:
    """The first rows in the natural order of their parcel numbers (then the numbers' text and order), as many as a report's preview shows."""
    return in_parcel_order(rows, F.col(number), number, order).limit(most).drop("_key")


def sheet_names(names: DataFrame, name: str, order: str) -> DataFrame:
    """names with sheet: repeats of a name get (2), (3), …"""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return names.withColumn("sheet", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("("), n.cast("string"), F.lit(")"))))


def ring_layout(rings: DataFrame) -> DataFrame:
    """(ring_id, page, sheet, row, col, value): 100 stakes to a page in four columns of 25; the block at (3, 0), the parcel at
    (3, 6). rings: ring_id, parcel_number, ring. Every page repeats the two.
    """
    pages = rings.withColumn("_blocks", _blocks(F.col("ring"))).withColumn("block", _modal(F.col("_blocks"))).drop("_blocks").withColumn("page", F.explode(F.sequence(F.lit(0), ((F.size("ring") + RING_PAGE - 1) / RING_PAGE).cast("int") - 1))).withColumn("wanted", F.concat("parcel_number", F.when(F.col("page") > 0, F.concat(F.lit("_"), (F.col("page") + 1).cast("string"))).otherwise("")))
    named = sheet_names(pages.withColumn("_ord", F.struct("ring_id", "page")), "wanted", "_ord")
    cell = lambda r, c, v: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), v.alias("value"))
    part = F.slice("ring", F.col("page") * RING_PAGE + 1, RING_PAGE)
    stakes = F.transform(part, lambda s, i: cell(F.lit(RING_ROW) + i % RING_COLUMN, F.get(F.array(*[F.lit(c) for c in RING_COLUMNS]), (i / RING_COLUMN).cast("int")), s))
    heads = F.array(cell(F.lit(3), F.lit(6), F.col("parcel_number")))
    block = F.when(F.col("block").isNotNull(), F.array(cell(F.lit(3), F.lit(0), F.col("block")))).otherwise(F.array().cast("array<struct<row:int,col:int,value:string>>"))
    return named.select("ring_id", "page", "sheet", F.explode(F.concat(heads, block, stakes)).alias("c")).select("ring_id", "page", "sheet", "c.*")


def intersection_layout(points: DataFrame, order: str) -> DataFrame:
    """(sheet, row, col, value): intersections by block, 15 to a page in 5 rows of 3; further pages of a block get _2, _3, …

    Stakes without a block go to sheet 0. Empty values take no cell.
    """
    block = F.coalesce(block_number(F.col("intersection_stake")), F.lit("0"))
    n = F.row_number().over(Window.partitionBy("block").orderBy(order)) - 1
    placed = points.withColumn("block", block).withColumn("_n", n).withColumn("page", (F.col("_n") / POINTS_PAGE).cast("int")).withColumn("slot", F.col("_n") % POINTS_PAGE)
    sheet = F.concat("block", F.when(F.col("page") > 0, F.concat(F.lit("_"), (F.col("page") + 1).cast("string"))).otherwise(""))
    centre = F.get(F.array(*[F.lit(r) for r in CENTRE_ROWS]), (F.col("slot") / POINTS_ACROSS).cast("int"))
    across = F.col("slot") % POINTS_ACROSS * COLUMN_STEP
    cells = F.array(*[F.struct((centre + r).alias("row"), (across + c).cast("int").alias("col"), F.col(name).alias("value")) for name, r, c in POINT_CELLS])
    return placed.select(sheet.alias("sheet"), F.explode(cells).alias("c")).select("sheet", "c.*").where("value <> ''")
