"""Elevation rasters as pixel tables: tile arithmetic, mosaics, slope, and shares of slope classes inside a polygon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE, EQUATOR = 256, 2 * math.pi * 6378137.0
#: Lower and upper bound in degrees, name, colour.
SLOPE_CLASSES = (
    (0, 5, "平坦地", "#2ecc71"),
    (5, 15, "緩傾斜地", "#a8e063"),
    (15, 25, "中傾斜地", "#f1c40f"),
    (25, 35, "急傾斜地(1)", "#e67e22"),
    (35, 45, "急傾斜地(2)", "#e74c3c"),
    (45, 90, "急峻地", "#8e0000"),
)


def tile_x(lon: Column, zoom: Column) -> Column:
    return ((lon + 180) / 360 * F.pow(F.lit(2.0), zoom)).cast("int")


def tile_y(lat: Column, zoom: Column) -> Column:
    rad = F.radians(lat)
    return ((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * F.pow(F.lit(2.0), zoom)).cast("int")


def tile_lon(x: Column, zoom: Column) -> Column:
    """West edge of tile x."""
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def tile_lat(y: Column, zoom: Column) -> Column:
    """North edge of tile y."""
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def pixel_width(lat: Column, zoom: Column) -> Column:
    """Metres; shrinks with latitude."""
    return EQUATOR * F.cos(F.radians(lat)) / (TILE * F.pow(F.lit(2.0), zoom))


def pixel_height(zoom: Column) -> Column:
    """Metres; by convention not scaled with latitude."""
    return EQUATOR / (TILE * F.pow(F.lit(2.0), zoom))


def tile_cover(boxes: DataFrame) -> DataFrame:
    """boxes (lat_min, lat_max, lon_min, lon_max, zoom, ...) with a row for each tile (tx, ty)."""
    xs = F.explode(F.sequence(tile_x(F.col("lon_min"), F.col("zoom")), tile_x(F.col("lon_max"), F.col("zoom"))))
    ys = F.explode(F.sequence(tile_y(F.col("lat_max"), F.col("zoom")), tile_y(F.col("lat_min"), F.col("zoom"))))
    return boxes.withColumn("tx", xs).withColumn("ty", ys)


def too_large(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, most: float = 0.25) -> Column:
    return (lat_max - lat_min) * (lon_max - lon_min) > most


def rgb_elevation(red: Column, green: Column, blue: Column) -> Column:
    """Metres; null for the no-data colour."""
    u = red.cast("long") * 65536 + green * 256 + blue
    return F.when((red == 128) & (green == 0) & (blue == 0), None).when(u >= 8388608, (u - 16777216) / 100).otherwise(u / 100)


def quantise(elevation: Column) -> Column:
    """Tenths of a metre as a 16-bit integer, half to even; no data is -32768."""
    return F.coalesce(F.greatest(F.lit(-32767), F.least(F.lit(32767), F.bround(elevation * 10).cast("long"))), F.lit(-32768)).cast("short")


def preferred_tiles(tiles: DataFrame) -> DataFrame:
    """(tx, ty, prio, body): of each tile's sources the first, by prio, whose body is not blank."""
    first = Window.partitionBy("tx", "ty").orderBy("prio")
    return tiles.where("trim(body) <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def tile_pixels(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """(tx, ty, row, col, elev): every pixel of text tiles (body: lines of comma-separated values); what is missing, 'e' or no
    number is null, and what is too much is cut."""
    lines = tiles.select("tx", "ty", F.posexplode(F.split("body", "\n")).alias("row", "line"))
    cells = lines.select("tx", "ty", "row", F.posexplode(F.split("line", ",")).alias("col", "v")).where((F.col("row") < size) & (F.col("col") < size)).select("tx", "ty", "row", "col", F.trim("v").try_cast("double").alias("elev"))
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    grid = tiles.select("tx", "ty").distinct().withColumn("row", F.explode(axis)).withColumn("col", F.explode(axis))
    return grid.join(cells, ["tx", "ty", "row", "col"], "left")


def mosaic(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """(row, col, elev) over the whole mosaic of tile pixels."""
    corner = pixels.agg(F.min("tx").alias("x"), F.min("ty").alias("y")).first()
    return pixels.select(((F.col("ty") - F.lit(corner["y"])) * size + F.col("row")).alias("row"), ((F.col("tx") - F.lit(corner["x"])) * size + F.col("col")).alias("col"), "elev")


def mosaic_bounds(tiles: DataFrame, zoom: int) -> DataFrame:
    """(north, south, west, east) of a mosaic of tiles (tx, ty)."""
    ends = tiles.agg(F.min("tx").alias("x1"), F.max("tx").alias("x2"), F.min("ty").alias("y1"), F.max("ty").alias("y2"))
    z = F.lit(zoom)
    return ends.select(tile_lat(F.col("y1"), z).alias("north"), tile_lat(F.col("y2") + 1, z).alias("south"), tile_lon(F.col("x1"), z).alias("west"), tile_lon(F.col("x2") + 1, z).alias("east"))


def valid_percent(dem: DataFrame) -> DataFrame:
    """(valid_percent): the share of pixels (elev) with data."""
    return dem.agg((F.count("elev") * 100 / F.count("*")).alias("valid_percent"))


def fill_no_data(dem: DataFrame) -> DataFrame:
    """dem (row, col, elev) with filled: the mosaic's mean in place of no data (0 if all is)."""
    mean = dem.agg(F.avg("elev").alias("m")).first()["m"]
    return dem.withColumn("filled", F.coalesce("elev", F.lit(0.0 if mean is None else float(mean))))


def slope(dem: DataFrame, width: float, height: float) -> DataFrame:
    """dem (row, col, elev) with slope in degrees: central differences inside, one-sided at the edges; null stays null.

    Neighbours meet in one aggregation by (row, col), not in windows over whole rows of a raster.
    """
    filled = fill_no_data(dem)

    def step(axis: str, size: float) -> Column:
        after, before = F.col(f"_after_{axis}"), F.col(f"_before_{axis}")
        here = F.col("filled")
        return F.when(after.isNotNull() & before.isNotNull(), (after - before) / (2 * size)).when(after.isNotNull(), (after - here) / size).when(before.isNotNull(), (here - before) / size).otherwise(0.0)

    # each pixel sends its value to its four neighbours; one aggregation brings them together
    def sent(dr: int, dc: int, name: str) -> Column:
        return F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(name).alias("to"))

    moves = F.explode(F.array(sent(0, 0, "here"), sent(0, -1, "_after_col"), sent(0, 1, "_before_col"), sent(-1, 0, "_after_row"), sent(1, 0, "_before_row")))
    dealt = filled.select("elev", "filled", moves.alias("m")).select("m.row", "m.col", "m.to", "elev", "filled")
    only = lambda name, c: F.max(F.when(F.col("to") == name, F.col(c)))
    names = ("_after_col", "_before_col", "_after_row", "_before_row")
    met = dealt.groupBy("row", "col").agg(only("here", "elev").alias("elev"), only("here", "filled").alias("filled"), *[only(n, "filled").alias(n) for n in names]).where("filled is not null")
    gx, gy = step("col", width), step("row", height)
    return met.select("row", "col", "elev", F.when(F.col("elev").isNotNull(), F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))).alias("slope"))


def slope_class(degrees: Column) -> Column:
    """0 to 5, or -1 for no data and 90 or more."""
    out = F.lit(-1)
    for i, (low, high, _, _) in enumerate(SLOPE_CLASSES):
        out = F.when((degrees >= low) & (degrees < high), i).otherwise(out)
    return out


def crossings(spark: SparkSession, polygon: list[tuple[float, float]], north: float, step: float, rows: int) -> DataFrame:
    """(row, at): where the sides of a polygon of (x, y) cross the rows' lines y = north + row * step, for rows 0 to rows.

    One row of a table for each side and a short list for each line, however many sides there are.
    """
    sides = spark.createDataFrame([(float(x1), float(y1), float(x2), float(y2)) for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True) if y1 != y2], "x1 double, y1 double, x2 double, y2 double")
    near = [(F.col(c) - north) / step for c in ("y1", "y2")]
    first, last = F.greatest(F.lit(0), F.floor(F.least(*near)) - 1), F.least(F.lit(rows), F.ceil(F.greatest(*near)) + 1)
    y = F.lit(north) + F.col("row") * step
    met = sides.where(first <= last).withColumn("row", F.explode(F.sequence(first, last))).where((F.col("y1") > y) != (F.col("y2") > y))
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return met.groupBy("row").agg(F.collect_list(at).alias("at"))


def inside_polygon(spark: SparkSession, pixels: DataFrame, polygon: list[tuple[float, float]], north: float, dlat: float, west: float, dlon: float, rows: int) -> DataFrame:
    """The pixels (row, col, ...) whose place lies in a polygon of (lon, lat): an odd number of sides crosses the ray to their right."""
    x = F.lit(west) + F.col("col") * dlon
    met = pixels.join(crossings(spark, polygon, north, dlat, rows), "row")
    return met.where(F.size(F.filter("at", lambda c: x < c)) % 2 == 1).drop("at")


def zonal_stats(spark: SparkSession, sloped: DataFrame, polygon: list[tuple[float, float]], bounds: tuple[float, float, float, float], pixel_area: float) -> DataFrame:
    """(class, name, color, n, area_m2, area_ha, percent) of all six classes over the pixels inside a polygon of (lon, lat).

    bounds: north, south, west, east; pixels lie evenly from edge to edge, both included. Square metres have one place, hectares three,
    percents two.
    """
    size = sloped.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    north, south, west, east = bounds
    rows, cols = max(int(size["r"] or 0), 1), max(int(size["c"] or 0), 1)
    inside = inside_polygon(spark, sloped, polygon, north, (south - north) / rows, west, (east - west) / cols, rows)
    counts = inside.withColumn("class", slope_class(F.col("slope"))).where("class >= 0").groupBy("class").agg(F.count("*").alias("n"))
    classes = spark.createDataFrame([(i, name, color) for i, (_, _, name, color) in enumerate(SLOPE_CLASSES)], "class int, name string, color string")
    full = classes.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # six rows
    area = F.col("n") * pixel_area
    return full.select("class", "name", "color", "n", F.round(area, 1).alias("area_m2"), F.round(F.round(area, 1) / 10000, 3).alias("area_ha"), F.round(F.when(total > 0, F.col("n") * 100 / total).otherwise(0.0), 2).alias("percent"))
