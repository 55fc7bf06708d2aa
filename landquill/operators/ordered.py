"""Running values and neighbours over long ordered files, without one task for a whole file.

A file's rows are cut into chunks by their order number. What a row needs from the chunks before it is one number for each of
them, so that only a small table of chunks is put in order by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16  # of order numbers


def running_all(rows: DataFrame, values: dict[str, tuple[Column, str]], file: str | tuple[str, ...], order: str) -> DataFrame:
    """rows with a column for each of values, name: (value, kind), over the rows of the file up to here: the kind 'sum', 'max' or 'min' of value.

    Nulls count as nothing. max and min take structs too: with an order number in front they are the last or first value so far. file: one
    column or several; order numbers are unique in a file.
    """
    keys = (file,) if isinstance(file, str) else file
    merges = {"sum": F.sum, "max": F.max, "min": F.min}
    cut = rows.withColumns({f"_v_{n}": v for n, (v, _) in values.items()} | {"_chunk": F.floor(F.col(order) / CHUNK)})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(*keys, "_chunk").agg(*[merges[k](f"_v_{n}").alias(f"_w_{n}") for n, (_, k) in values.items()])
    carry = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_chunk_at"), *[merges[k](f"_w_{n}").over(before).alias(f"_c_{n}") for n, (_, k) in values.items()])
    met = F.col("_chunk") == F.col("_chunk_at")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.withColumns({f"_h_{n}": merges[k](f"_v_{n}").over(inside) for n, (_, k) in values.items()}).join(carry, met)

    def total(n: str, kind: str) -> Column:
        here, past = F.col(f"_h_{n}"), F.col(f"_c_{n}")
        return {"sum": lambda: F.coalesce(here + past, here, past, F.lit(0)), "max": lambda: F.greatest(here, past), "min": lambda: F.least(here, past)}[kind]()

    return joined.withColumns({n: total(n, k) for n, (_, k) in values.items()}).drop("_chunk", "_chunk_at", *[f"_k{i}" for i in range(len(keys))], *[f"{p}_{n}" for n in values for p in ("_v", "_h", "_c")])


def running(rows: DataFrame, value: Column, name: str, file: str | tuple[str, ...], order: str, kind: str = "sum") -> DataFrame:
    """rows with name: the sum (or kind: the 'max' or 'min') of value over the rows of the file up to here; see running_all."""
    return running_all(rows, {name: (value, kind)}, file, order)


def in_one_order(rows: DataFrame, name: str, file: str, order: str) -> DataFrame:
    """rows with name: 1, 2, 3, … over all files, in the order of file. Only the table of files, with their counts, is put in order in one task."""
    each = rows.groupBy(file).agg(F.count("*").alias("_n"))
    start = each.select(F.col(file).alias("_file"), F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col(file)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = numbered(rows, name, file, order)
    return inside.join(start, F.col(file).eqNullSafe(F.col("_file"))).withColumn(name, F.col(name) + F.col("_start")).drop("_file", "_start")


def numbered(rows: DataFrame, name: str, file: str, order: str) -> DataFrame:
    """rows with name: 1, 2, 3, … in each file."""
    return running(rows, F.lit(1).cast("long"), name, file, order)


def with_neighbours(rows: DataFrame, place: str, behind: int, ahead: int, size: int = CHUNK) -> DataFrame:
    """Rows in chunks that overlap by so many rows: (…, _part, _home). Windows by file and _part, in order of place, see their neighbours;
    keep the rows with _home afterwards. place: 1, 2, 3, … in each file.
    """
    own = F.floor((F.col(place) - 1) / size)
    into = (F.col(place) - 1) % size
    parts = [F.struct(own.alias("part"), F.lit(True).alias("home"))]
    if ahead:
        parts.append(F.when((into < ahead) & (own > 0), F.struct((own - 1).alias("part"), F.lit(False).alias("home"))))
    if behind:
        parts.append(F.when(into >= size - behind, F.struct((own + 1).alias("part"), F.lit(False).alias("home"))))
    return rows.withColumn("_in", F.explode(F.array_compact(F.array(*parts)))).withColumns({"_part": F.col("_in.part"), "_home": F.col("_in.home")}).drop("_in")
