"""Cheapest one-to-one pairs in groups of any size: auctions in tiles of the plane, over shrinking steps.

Every left row can stay alone at a fixed price, and every right row for nothing. Both become bidders, and both are on sale: a left row bids for
the right rows near it, or for its own place; a right row bids for itself, or for the place of a left row near it (which is free for it if they form a
pair). Such a market always clears, so that any prices are a fair start, and steps can shrink from one phase to the next. When a phase ends,
no bidder can gain more than the step, so that the total is within (number of bidders) * (last step) of the least.

A round is one Spark job: the plane is cut into tiles, each tile runs its own auction to the end in one task, with the prices of what lies
just outside as they were before. These can only rise, so that a bid for something inside is always a valid one; a bidder that prefers something outside
waits. From round to round the tiles move by half their width, so that each pair lies inside of a tile in one of four rounds.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import materialise

TILE_ROWS = 4000  # bidders of a tile, as long as a tile is wider than four reaches
SHRINK, LAST_STEP = 8.0, 1e-9  # of the reach
_OBJECT = "oid long, x double, y double, price double, owner long"


def _tiles(x: Column, y: Column, side: float, move: tuple[int, int]) -> Column:
    return F.struct(F.floor((x + move[0] * side / 2) / side).alias("tx"), F.floor((y + move[1] * side / 2) / side).alias("ty"))


def _market(step: float, fields: list[str]):
    """The auction of one tile: bidders (pid, edges) and objects (oid, price, owner, home)."""

    def run(bidders: pa.Table, objects: pa.Table) -> pa.Table:
        place = {o: k for k, o in enumerate(objects.column("oid").to_pylist())}
        price = objects.column("price").to_pylist()
        owner = objects.column("owner").to_pylist()
        home = objects.column("home").to_pylist()
        wants = {}
        for pid, edges in zip(bidders.column("pid").to_pylist(), bidders.column("edges").to_pylist(), strict=True):
            wants[pid] = [(place[e["oid"]], e["gain"]) for e in edges]
        taken = {p for p in owner if p is not None}
        waiting = [p for p in sorted(wants) if p not in taken]
        heapq.heapify(waiting)
        while waiting:
            pid = heapq.heappop(waiting)
            first, second, best = float("-inf"), float("-inf"), -1
            for k, gain in wants[pid]:
                value = gain - price[k]
                if value > first:
                    first, second, best = value, first, k
                elif value > second:
                    second = value
            if not home[best]:
                continue
            price[best] += first - second + step
            before, owner[best] = owner[best], pid
            if before in wants:
                heapq.heappush(waiting, before)
        kept = np.flatnonzero(np.array(home, bool))
        out = objects.take(pa.array(kept)).select([*fields, "oid", "x", "y"])
        return out.append_column("price", pa.array([price[k] for k in kept], pa.float64())).append_column("owner", pa.array([owner[k] for k in kept], pa.int64()))

    return run


def auction(pairs: DataFrame, reach: float, alone: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of a cheapest one-to-one choice among pairs (by, left_id, right_id, cost, x, y, rx, ry, ...), where a left row without a partner costs alone.

    Both ends of a pair are closer than reach. left_id and right_id are unique within by.
    """
    numbered = []
    for side in ("left", "right"):
        names = [*by, f"{side}_id"]
        numbered.append(materialise(pairs.select(*names).distinct().withColumn(f"{side}_no", F.monotonically_increasing_id())))
    pairs = materialise(pairs.join(numbered[0], [*by, "left_id"]).join(numbered[1], [*by, "right_id"]))
    left_item, right_item = F.col("left_no") * 2 + 1, F.col("right_no") * 2
    edge = lambda oid, gain: F.struct(oid.alias("oid"), gain.cast("double").alias("gain"))
    of_left = pairs.groupBy(*by, (F.col("left_no") * 2).alias("pid")).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.collect_list(edge(right_item, -F.col("cost"))).alias("near"), F.first(left_item).alias("own"))
    bidders = of_left.select(*by, "pid", "x", "y", F.concat("near", F.array(edge(F.col("own"), F.lit(-alone)))).alias("edges"))
    of_right = pairs.groupBy(*by, (F.col("right_no") * 2 + 1).alias("pid")).agg(F.first("rx").alias("x"), F.first("ry").alias("y"), F.collect_list(edge(left_item, F.lit(0.0))).alias("near"), F.first(right_item).alias("own"))
    bidders = materialise(bidders.unionByName(of_right.select(*by, "pid", "x", "y", F.concat("near", F.array(edge(F.col("own"), F.lit(0.0)))).alias("edges"))))
    # on sale: each left row's own place, where it stands, and each right row
    start = lambda oid: bidders.where(F.col("pid") % 2 == (0 if oid == "left" else 1)).select(*by, (F.col("pid") + (1 if oid == "left" else -1)).alias("oid"), "x", "y")
    objects = start("left").unionByName(start("right")).withColumns({"price": F.lit(0.0), "owner": F.lit(None).cast("long")})
    side = 64.0 * reach
    while side > 4 * reach and bidders.groupBy(*by, _tiles(F.col("x"), F.col("y"), side, (0, 0))).count().agg(F.max("count")).first()[0] > TILE_ROWS:
        side /= 2
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*by).schema.fields)
    schema = (schema + ", " if schema else "") + _OBJECT
    turns = itertools.cycle([(0, 0), (1, 0), (1, 1), (0, 1)])
    step = reach
    while True:
        objects = objects.withColumn("owner", F.lit(None).cast("long"))
        free = 1
        while free:
            move = next(turns)
            keys = [*by, "tile"]
            asked = bidders.withColumn("tile", _tiles(F.col("x"), F.col("y"), side, move))
            corners = F.array_distinct(F.array(*[_tiles(F.col("x") + a * reach, F.col("y") + b * reach, side, move) for a in (-1, 1) for b in (-1, 1)]))
            offered = objects.withColumn("tile", F.explode(corners)).withColumn("home", F.col("tile") == _tiles(F.col("x"), F.col("y"), side, move))
            objects = materialise(asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(_market(step, list(by)), schema))
            free = objects.where("owner is null").limit(1).count()
        if step <= reach * LAST_STEP:
            break
        step = max(step / SHRINK, reach * LAST_STEP)
    sold = objects.where("oid % 2 = 0 and owner % 2 = 0").select((F.col("oid") / 2).cast("long").alias("right_no"), (F.col("owner") / 2).cast("long").alias("left_no"))
    return pairs.join(sold, ["left_no", "right_no"]).drop("left_no", "right_no")
