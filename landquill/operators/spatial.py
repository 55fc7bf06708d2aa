"""Joins by distance: nearest within a threshold, line ends to stakes, one-to-one assignment, containment.

All use one idea: space is cut into square cells of the threshold's size, the right side is copied to the nine cells around
it, and an equi-join on the cell finds what is near; no nested loop over all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .auction import auction
from .graph import components, materialise

#: Rows of a group of near points that one task solves; what leaving a row out costs, in reaches.
LOCAL_ROWS, ALONE = 500, 100
#: Sides of a face that a grid cell holds.
FEW_SIDES = 64


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _cell(c: Column, size: float | Column) -> Column:
    return F.floor(c / (size if isinstance(size, Column) else F.lit(size)))


def near_pairs(left: DataFrame, right: DataFrame, size: float | str, by: tuple[str, ...] = (), wide: int = 1) -> DataFrame:
    """Columns of left (x, y, ...) and right (rx, ry, ...) with d < size; names of the two sides must differ, but for by: rows only meet where these are equal.

    size: a number, or the name of a column that both sides hold, with one value for each by. wide: a cell's width in sizes; right rows are copied to
    nine cells of one size, but mostly to one or two of four sizes, where more rows meet that are not near.
    """
    reach = F.col(size) if isinstance(size, str) else F.lit(float(size))
    cells = lambda c: F.explode(F.sequence(_cell(c - reach, reach * wide), _cell(c + reach, reach * wide)))
    spread = right.withColumn("_cx", cells(F.col("rx"))).withColumn("_cy", cells(F.col("ry"))).drop(*([size] if isinstance(size, str) else []))
    dealt = left.withColumn("_cx", _cell(F.col("x"), reach * wide)).withColumn("_cy", _cell(F.col("y"), reach * wide))
    pairs = dealt.join(spread, [*by, "_cx", "_cy"]).withColumn("d", distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry")))
    return pairs.where(F.col("d") < reach).drop("_cx", "_cy")


def nearest_within(left: DataFrame, right: DataFrame, size: float | str, left_id: str, right_order: str, take: tuple[str, ...], by: tuple[str, ...] = (), crowded: bool = False, wide: int = 1) -> DataFrame:
    """left with d and the columns take of its nearest right row closer than size (null if none); ties to the lower right_order. left_id is unique within by.

    crowded: many right rows are near to one left row. The least distance is found first, which needs no sort of all pairs, and only pairs at
    that distance are put in order. wide: see near_pairs.
    """
    reach = [size] if isinstance(size, str) else []
    mine, least = left.select(*by, left_id, "x", "y", *reach), F.lit(True)
    if crowded:
        closest = near_pairs(mine, right, size, by, wide).groupBy(*by, left_id).agg(F.min("d").alias("_least"))
        mine, least = mine.join(closest, [*by, left_id]), F.col("d") == F.col("_least")
    best = near_pairs(mine, right, size, by, wide).where(least).groupBy(*by, left_id).agg(F.min_by(F.struct("d", *take), F.struct("d", right_order)).alias("_best"))
    return left.join(best, [*by, left_id], "left").select(*[F.col(c) for c in left.columns], F.col("_best.d").alias("d"), *[F.col(f"_best.{c}").alias(c) for c in take])


def line_ends(lines: DataFrame, stakes: DataFrame, name: str, size: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, line_id, u, v), u <= v: the names of the stakes nearest to both ends of each line, where both are closer than size."""
    ends = lines.select(*by, "line_id", F.explode(F.array(F.struct(F.lit(1).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(2).alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select(*by, "line_id", "e.*").withColumn("end_id", F.col("line_id") * 2 + F.col("end"))
    right = stakes.where(F.col(name).isNotNull()).select(*by, F.col(name).alias("stake"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("stake_id").alias("ord"))
    hit = nearest_within(ends, right, size, "end_id", "ord", ("stake",), by, wide=4).where("stake is not null")
    both = hit.groupBy(*by, "line_id").agg(F.min("stake").alias("u"), F.max("stake").alias("v"), F.count("*").alias("n"))
    return both.where("n = 2").drop("n")


def edges(lines: DataFrame, stakes: DataFrame, name: str, size: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (by, u, v), u < v: lines whose ends both lie closer than size to a stake, by the stakes' names, if they differ."""
    return line_ends(lines, stakes, name, size, by).where("u <> v").select(*by, "u", "v").distinct()


def last_places(stakes: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, x, y) of each name: the place of its last stake."""
    return stakes.where(F.col(name).isNotNull()).groupBy(*by, F.col(name).alias("node")).agg(F.max_by(F.struct("x", "y"), "stake_id").alias("p")).select(*by, "node", "p.x", "p.y")


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a square cost matrix the column of a cheapest one-to-one assignment, by shortest augmenting paths."""
    n = len(cost)
    row_price, col_price, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for r in range(n):
        owner[n] = r
        best, come, seen, col = np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, bool), n
        while owner[col] >= 0:
            seen[col] = True
            slack = cost[owner[col]] - row_price[owner[col]] - col_price[:n]
            better = ~seen[:n] & (slack < best)
            best[better], come[better] = slack[better], col
            free = np.flatnonzero(~seen[:n])
            nxt = free[best[free].argmin()]
            step = best[nxt]
            row_price[owner[seen]] += step
            col_price[seen] -= step
            best[free] -= step
            col = nxt
        while col != n:
            owner[col] = owner[come[col]]
            col = come[col]
    out = np.empty(n, int)
    out[owner[:n]] = np.arange(n)
    return out


def assign(left: DataFrame, right: DataFrame, size: float | str = 5.0, by: tuple[str, ...] = (), local: int = LOCAL_ROWS) -> DataFrame:
    """(by, left_id, right_id, d): one-to-one pairs closer than size with the least total cost.

    left: left_id, x, y, layer; right: right_id, rx, ry, r_layer. Cost is the distance, times 0.8 on the same layer; as many
    pairs as possible are made, since leaving one out costs far more. size may be the name of a column of both sides (see near_pairs).

    Rows only compete within a group that near pairs connect. Where one row is near to several that are near to nothing else, the cheapest
    takes it. Other groups of up to local rows are solved in one task each; larger ones by auctions over the plane.
    """
    reach = F.col(size) if isinstance(size, str) else F.lit(float(size))
    near = near_pairs(left, right, size, by).withColumns({"cost": F.when(F.col("layer") == F.col("r_layer"), F.col("d") * 0.8).otherwise(F.col("d")), "reach": reach.cast("double")})
    pairs = near.select(*by, "left_id", "right_id", "d", "cost", "x", "y", "rx", "ry", "reach")
    one, other = Window.partitionBy(*by, "left_id"), Window.partitionBy(*by, "right_id")
    pairs = pairs.withColumn("_l", F.count("*").over(one)).withColumn("_r", F.count("*").over(other)).withColumn("_around_right", F.max("_l").over(other) == 1).withColumn("_around_left", F.max("_r").over(one) == 1)
    pairs = materialise(pairs.drop("_l", "_r"))
    out = [*by, "left_id", "right_id", "d"]
    take = lambda df, key, rest: df.groupBy(*by, key).agg(F.min_by(F.struct(rest, "d"), F.struct("cost", rest)).alias("b")).select(*by, key, f"b.{rest}", "b.d").select(*out)
    done = take(pairs.where("_around_right"), "right_id", "left_id").unionByName(take(pairs.where("_around_left and not _around_right"), "left_id", "right_id"))
    rest = pairs.where("not _around_right and not _around_left").drop("_around_right", "_around_left")
    if not rest.limit(1).count():
        return done
    # ids by hash: should two be equal, their groups are solved together
    node = lambda side: F.xxhash64(F.lit(side), *by, f"{side}_id")
    group = components(rest.select(node("left").alias("src"), node("right").alias("dst")))
    large = group.groupBy("component").agg(F.count("*").alias("rows"))
    dealt = materialise(rest.withColumn("id", node("left")).join(group, "id").join(large, "component").drop("id"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        sheet = pd.factorize(part[list(by)].apply(tuple, axis=1))[0] if by else np.zeros(len(part), int)
        kept = []
        for k in np.unique(sheet):
            mine = part[sheet == k]
            rows, cols = np.unique(mine.left_id), np.unique(mine.right_id)
            n = max(len(rows), len(cols))
            cost = np.full((n, n), ALONE * float(mine.reach.iloc[0]))
            at = np.searchsorted(rows, mine.left_id), np.searchsorted(cols, mine.right_id)
            cost[at] = mine.cost
            chosen = assignment(cost)
            kept.append(mine[chosen[at[0]] == at[1]])
        return pd.concat(kept)[out]

    small = dealt.where(F.col("rows") <= local)
    done = done.unionByName(small.groupBy("component").applyInPandas(solve, small.select(*out).schema))
    big = dealt.where(F.col("rows") > local)
    for r in big.select("reach").distinct().collect():  # one auction for each reach that occurs in large groups
        done = done.unionByName(auction(big.where(F.col("reach") == r["reach"]).drop("component", "rows"), r["reach"], ALONE * r["reach"], by).select(*out))
    return done


def _crosses(s: Column | None = None) -> Column:
    """Whether the side with x1, y1, x2, y2 (a struct, or columns) crosses the ray to the right of the point px, py."""
    x1, y1, x2, y2 = (F.col(k) if s is None else s[k] for k in ("x1", "y1", "x2", "y2"))
    return ((y1 > F.col("py")) != (y2 > F.col("py"))) & (F.col("px") < (x2 - x1) * (F.col("py") - y1) / F.when(y1 != y2, y2 - y1) + x1)


def faces_around(points: DataFrame, faces: DataFrame, cell: float, by: tuple[str, ...] = (), keep: tuple[str, ...] = (), take: tuple[str, ...] = ()) -> DataFrame:
    """(by, _cx, _cy, point_id, px, py, keep, face_id, area, take): every face that contains each point, with the grid cell _cx, _cy where they meet.

    points: point_id, x, y and the columns keep. faces: face_id, points (an array with x and y), area (absolute) and the columns take. A point is inside if it is in
    the face's box and an odd number of sides crosses the ray to its right. Each cell of a face's box holds the sides that touch its row of cells,
    so that a point meets all it needs in its own cell. Rows of cells with more than FEW_SIDES sides of a face are not copied to the cells:
    points meet them by face and row.
    """
    rows = lambda low, high: F.explode(F.sequence(_cell(low, cell), _cell(high, cell)))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    turned = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    ends = F.zip_with("points", turned, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    face = [*by, "face_id", "area", *take, "x_min", "x_max", "y_min", "y_max"]
    boxed = faces.select(*by, "face_id", "area", *take, F.array_min(xs).alias("x_min"), F.array_max(xs).alias("x_max"), F.array_min(ys).alias("y_min"), F.array_max(ys).alias("y_max"), F.filter(ends, lambda s: s["y1"] != s["y2"]).alias("sides"))
    touching = F.filter("sides", lambda s: (_cell(F.least(s["y1"], s["y2"]), cell) <= F.col("_cy")) & (_cell(F.greatest(s["y1"], s["y2"]), cell) >= F.col("_cy")))
    few = boxed.where(F.size("sides") <= FEW_SIDES).withColumn("_cy", rows(F.col("y_min"), F.col("y_max"))).withColumn("sides", touching)
    many = boxed.where(F.size("sides") > FEW_SIDES).select(*face, F.explode("sides").alias("s")).withColumn("_cy", rows(F.least("s.y1", "s.y2"), F.greatest("s.y1", "s.y2")))
    many = materialise(many.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "face_id", "_cy"))))
    short = many.where(F.col("_n") <= FEW_SIDES).groupBy(*face, "_cy").agg(F.collect_list("s").alias("sides"))
    dealt = points.select(*by, "point_id", F.col("x").alias("px"), F.col("y").alias("py"), *keep).withColumn("_cx", _cell(F.col("px"), cell)).withColumn("_cy", _cell(F.col("py"), cell))

    def boxes(table: DataFrame) -> DataFrame:
        """Points and the rows of faces in whose boxes they are."""
        cells = table.withColumn("_cx", rows(F.col("x_min"), F.col("x_max")))
        return dealt.join(cells, [*by, "_cx", "_cy"]).where((F.col("px") >= F.col("x_min")) & (F.col("px") <= F.col("x_max")) & (F.col("py") >= F.col("y_min")) & (F.col("py") <= F.col("y_max")))

    out = [*by, "_cx", "_cy", "point_id", "px", "py", *keep, "face_id", "area", *take]
    found = boxes(few.unionByName(short)).where(F.size(F.filter("sides", _crosses)) % 2 == 1).select(*out)
    long = many.where(F.col("_n") > FEW_SIDES)
    if not long.limit(1).count():
        return found
    sides = long.select(*by, "face_id", "_cy", "s.*")
    near = boxes(long.select(*face, "_cy").distinct()).select(*out)
    return found.unionByName(near.join(sides, [*by, "face_id", "_cy"]).groupBy(*out).agg(F.count_if(_crosses()).alias("n")).where("n % 2 = 1").select(*out))


def smallest_face(points: DataFrame, faces: DataFrame, cell: float, by: tuple[str, ...] = (), keep: tuple[str, ...] = (), take: tuple[str, ...] = ()) -> DataFrame:
    """(by, point_id, px, py, keep, face_id, take): the smallest face that contains each point; of equal areas the lower face_id. See faces_around.

    Grouped by cell first: rows of a point are in one part already.
    """
    point = [*by, "_cx", "_cy", "point_id", "px", "py", *keep]
    best = faces_around(points, faces, cell, by, keep, take).groupBy(*point).agg(F.min_by(F.struct("face_id", *take), F.struct("area", "face_id")).alias("_best"))
    return best.select(*by, "point_id", "px", "py", *keep, "_best.*")
