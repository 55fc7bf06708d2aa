"""Small helpers of the llm operators: shared checkpoints, connected components, table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landquill.operators.graph import components, materialise, shared_folder

__all__ = ["components", "materialise", "shared_folder", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
