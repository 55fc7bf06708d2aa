"""Written tables in the shared folder, and labels of connected components."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share; where it is unset, one of our own if there is one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "landquill-checkpoints")


_written: list[str] = []

PARTS, PART_SIZE = 1024, "16m"  # of a shuffle, before and after small ones are put together
FILE_PART = 8 << 20  # bytes of compressed files whose rows make one part of a shuffle


def broadcast_by_measure(spark: SparkSession) -> None:
    """From now on the session sends a table to the driver and all executors only if it was measured in a shuffle to be small, or by F.broadcast.

    Spark would go by the size of files otherwise, and names and rings take up to a hundred times as much memory as in a compressed file.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(static) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(static))
        spark.conf.set(static, "-1")


def many_parts(spark: SparkSession) -> None:
    """From now on shuffles of the session start with many parts, and small ones are put together up to a size that still fits into a task's memory
    when sorted: rows that are much alike take up to twenty times as much there as in a shuffle's files. Many small rounds are slower so.
    """
    for name, value in (("coalescePartitions.initialPartitionNum", str(max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))), ("advisoryPartitionSizeInBytes", PART_SIZE)):
        if spark.conf.get(f"spark.sql.adaptive.{name}", None) in (None, "64MB", "67108864b"):
            spark.conf.set(f"spark.sql.adaptive.{name}", value)


@contextmanager
def many_parts_here(spark: SparkSession):
    """many_parts for tables that are written inside of it only: a session's many small rounds stay as they were."""
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    many_parts(spark)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def materialise(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: computed once, without lineage, and safe from lost executors. See release, broadcast_by_measure."""
    broadcast_by_measure(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(*frames: DataFrame) -> int:
    """How many parts to shuffle rows into that are read from files, such as written tables, so that a part's memory does not grow with the input: by the
    size of those files, but no fewer than the session's shuffles have. Without files, as many as those.
    """
    spark, size = frames[0].sparkSession, 0
    for name in {name for df in frames for name in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_PART))


def release(spark: SparkSession) -> int:
    """Delete the tables that this program has written with materialise so far, and tell how many; to be called when the results that
    read them are written or no longer needed.
    """
    for path in _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    n = len(_written)
    _written.clear()
    return n


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable over the undirected edges (src, dst).

    Each round hooks every root onto the smallest root next to it and then shortens the paths, so long chains need few
    rounds; only the count of labels that changed reaches the driver. Ids without an edge have no row. Edges with a null
    end and loops are ignored.
    """
    edges = materialise(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    label = materialise(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    for _ in range(rounds):
        ends = edges.join(label.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b")
        hook = ends.select(F.greatest("a", "b").alias("root"), F.least("a", "b").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        # a label is a root's id or an id on the way to it: follow hooks and labels one step each
        step = label.join(hook.withColumnRenamed("root", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("via"), F.col("component").alias("old"))
        up = label.select(F.col("id").alias("via"), F.col("component").alias("next"))
        moved = materialise(step.join(up, "via", "left").select("id", F.coalesce("next", "via").alias("component"), "old"))
        changed = moved.where("component <> old").limit(1).count()
        label = moved.select("id", "component")
        if not changed:
            return label
    raise RuntimeError(f"no fixed point after {rounds} rounds")
