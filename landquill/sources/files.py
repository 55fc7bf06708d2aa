"""Registry and drawing files as DataFrames that keep the order of their lines, and writers for the reports.

A file is decoded and split as a whole in one task (its encoding and quoting need that); many files are read in parallel.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered, running

ENCODINGS = ("cp932", "utf-8-sig", "utf-8")
# Names of side files and of the reports' columns.
SIDE_FILES = ":Zone.Identifier|:mshield"
DIFF_HEADERS = ("差分種別", "物件キー", "所在", "地番", "項目", "変更前", "変更後", "旧ファイル", "新ファイル", "備考")
PAIR_HEADERS = ("旧ファイル", "新ファイル", "旧物件数", "新物件数", "差分件数", "追加", "削除", "変更")


def registry_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(file, path, content) of the plain files of a folder that match, without the system's side files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "content").where(~F.col("file").rlike(SIDE_FILES))


def decode(content: bytes, encodings: tuple[str, ...] = ENCODINGS, strict: bool = True) -> str:
    """Text in the first encoding that reads all of it; not strict: the first encoding, with replacement characters."""
    if not strict:
        return content.decode(encodings[0], "replace")
    for name in encodings:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {', '.join(encodings)} reads the file")


def csv_rows(files: DataFrame, encodings: tuple[str, ...] = ENCODINGS, strict: bool = True) -> DataFrame:
    """(file, line_idx, fields): the rows of CSV files in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(csv.reader(io.StringIO(decode(content, encodings, strict), newline="")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["file", "line_idx", "fields"])

    return files.select("file", "content").mapInArrow(run, "file string, line_idx long, fields array<string>")


def table_rows(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of CSV files with a header as named text columns, with file and line_idx; the header gives the places."""
    header = rows.where("line_idx = 0").select("file", F.col("fields").alias("header"))
    body = rows.where("line_idx > 0").join(header, "file")
    return body.select("file", "line_idx", *[F.coalesce(F.get("fields", F.array_position("header", c).cast("int") - 1), F.lit("")).alias(c) for c in columns])


def snapshot(spark: SparkSession, folder: str, tables: list[str], kind: str = "csv") -> dict[str, DataFrame]:
    """Tables of a folder, every column as text; blanks stay empty. Tables that cannot be opened are left out."""
    out = {}
    for t in tables:
        reader = spark.read.option("header", True).option("emptyValue", "").option("nullValue", "\u0000") if kind == "csv" else spark.read
        try:
            df = reader.format(kind).load(f"{folder}/{t}.{kind}")
        except AnalysisException:
            continue
        out[t] = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    return out


def entities_from_tags(lines: DataFrame) -> DataFrame:
    """Entities from a drawing's tag stream: (drawing_id, line_idx, text), a code and its value on alternate lines.

    Code 0 opens an entity; 8 is its layer, 10/20 and 11/21 its points (vertices of polylines repeat 10/20), 40 the radius
    or height and 1 the text.
    """
    # two lines are a pair; lines stay in their order by number
    counted = numbered(lines, "n", "drawing_id", "line_idx").withColumn("pair", F.floor((F.col("n") - 1) / 2))
    pairs = counted.groupBy("drawing_id", "pair").agg(F.min("line_idx").alias("line_idx"), F.min_by("text", "n").alias("code"), F.max_by("text", "n").alias("value"), F.count("*").alias("both")).where("both = 2")
    paired = pairs.select("drawing_id", "line_idx", F.trim("code").try_cast("int").alias("code"), F.trim("value").alias("value"))
    grouped = running(paired, F.when(F.col("code") == 0, 1).otherwise(0).cast("long"), "ord", "drawing_id", "line_idx").where("ord > 0")
    first = lambda code: F.min(F.when(F.col("code") == code, F.struct("line_idx", "value")))["value"]
    last = lambda code: F.max(F.when(F.col("code") == code, F.struct("line_idx", "value")))["value"]
    number = lambda v: v.try_cast("double")
    out = grouped.groupBy("drawing_id", "ord").agg(
        first(0).alias("etype"),
        F.coalesce(first(8), F.lit("0")).alias("layer"),
        number(first(10)).alias("x1"),
        number(first(20)).alias("y1"),
        number(F.coalesce(first(11), F.when(first(0) == "LWPOLYLINE", last(10)))).alias("x2"),
        number(F.coalesce(first(21), F.when(first(0) == "LWPOLYLINE", last(20)))).alias("y2"),
        F.when(first(0) == "CIRCLE", number(first(40))).alias("radius"),
        first(1).alias("text"),
        F.when(first(0) == "LWPOLYLINE", F.count_if(F.col("code") == 10)).alias("n_points"),
    )
    return out.where(F.col("etype").isin("CIRCLE", "TEXT", "MTEXT", "LINE", "LWPOLYLINE"))


def write_diff(diff: DataFrame, path: str) -> None:
    """A registry diff with the report's ten columns; what diff lacks stays empty."""
    names = {"差分種別": "kind", "物件キー": "key", "所在": "location", "地番": "parcel_no", "項目": "item", "変更前": "old_value", "変更後": "new_value", "旧ファイル": "old_file", "新ファイル": "new_file", "備考": "note"}
    diff.select(*[(F.col(names[h]) if names[h] in diff.columns else F.lit("")).alias(h) for h in DIFF_HEADERS]).write.csv(path, header=True)


def write_pair_summary(pairs: DataFrame, path: str) -> None:
    names = ("old_file", "new_file", "n_old", "n_new", "n_diffs", "added", "deleted", "changed")
    pairs.select(*[F.col(n).alias(h) for n, h in zip(names, PAIR_HEADERS, strict=True)]).write.csv(path, header=True)


def write_pages(lines: DataFrame, path: str) -> None:
    """Scanned lines, a folder for each page."""
    lines.write.partitionBy("page").csv(path, header=True)


def write_text_rows(rows: DataFrame, path: str) -> None:
    """Rows of text boxes with their boxes as JSON."""
    rows.write.csv(path, header=True)
