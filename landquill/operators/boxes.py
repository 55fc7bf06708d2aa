"""Text boxes of a page: rows by height, and summaries of the engines that read them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_HEIGHT = 15.0


def row_numbers(tops: np.ndarray, height: float) -> np.ndarray:
    """Row of each box by its top, ascending, without a top first: a row ends at the first box over height below its first one. Boxes without a top are rows of their own."""
    none = int(np.isnan(tops).sum())
    out = np.empty(len(tops), np.int32)
    out[:none] = np.arange(none)
    at, row = none, none
    while at < len(tops):
        end = int(np.searchsorted(tops, tops[at] + height, "right"))
        # the sum may round the other way than the difference
        while end < len(tops) and tops[end] - tops[at] <= height:
            end += 1
        while end > at + 1 and tops[end - 1] - tops[at] > height:
            end -= 1
        out[at:end] = row
        at, row = end, row + 1
    return out


def group_text_rows(boxes: DataFrame, height: float = ROW_HEIGHT) -> DataFrame:
    """(page, row_no, text, confidence, n_boxes, detail_json): boxes in rows, in reading order.

    Boxes go by y, then x; a new row starts when a box is more than height below the *first* box of the row. In a row boxes
    go by x. boxes: page, box_id, text, conf, x_left, y_top. A page's tops, not its texts, have to fit into a task; each row is found by one search.
    """

    @F.pandas_udf("array<int>")
    def rows_of(tops: pd.Series) -> pd.Series:
        return tops.map(lambda y: row_numbers(np.array(y, float), height))

    order = F.struct("y_top", "x_left", "box_id")
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(order)).alias("b")).withColumn("rows", rows_of(F.transform("b", lambda q: q["y_top"].cast("double"))))
    placed = pages.select("page", F.explode(F.arrays_zip(F.col("b")["box_id"].alias("box_id"), "rows")).alias("z")).select("page", F.col("z.rows").alias("row_no"), F.col("z.box_id").alias("box_id"))
    one = placed.join(boxes, ["page", "box_id"])
    row = one.groupBy("page", "row_no").agg(F.array_sort(F.collect_list(F.struct("x_left", "y_top", "box_id", "text", "conf"))).alias("b"), F.avg("conf").alias("confidence"), F.count("*").alias("n_boxes"))
    return row.select("page", "row_no", F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("text"), "confidence", "n_boxes", F.to_json("b").alias("detail_json"))


def engine_summary(runs: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Runs, errors, time, tokens and cost (prices a million tokens) by model; failed runs count as errors only."""
    fine = ~F.col("failed")
    only = lambda c: F.coalesce(F.sum(F.when(fine, F.col(c))), F.lit(0))
    return runs.groupBy("model").agg(F.count("*").alias("n_runs"), F.count_if(F.col("failed")).alias("n_errors"), only("elapsed").alias("total_s"), F.avg(F.when(fine, F.col("elapsed"))).alias("avg_s"), only("input_tokens").alias("input_tokens"), only("output_tokens").alias("output_tokens"), ((only("input_tokens") * input_price + only("output_tokens") * output_price) / 1e6).alias("cost"))
