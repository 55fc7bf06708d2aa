"""Intersection stakes: the straight line they lie on, and the direction they were set out from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_number, is_intersection
from .graph import materialise

STRAIGHT, BEND = math.radians(20.0), math.radians(45.0)
#: Less than this, by what sums of angles can lose, and a walk has not come round.
HALF_CIRCLE = math.pi - 1e-6


def angle_between(a: Column, b: Column) -> Column:
    """Difference of two headings, folded to 0..pi."""
    d = F.abs(a - b)
    return F.when(d > math.pi, 2 * math.pi - d).otherwise(d)


def headings(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, u, v, heading) both ways."""
    both = edges.select(*by, "u", "v").union(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    at = both.join(nodes.select(*by, F.col("node").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), [*by, "u"]).join(nodes.select(*by, F.col("node").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), [*by, "v"])
    return at.select(*by, "u", "v", F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")).alias("heading"))


def collinear_pairs(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, a, b), a < b: neighbours of a node whose headings are opposite within 20 degrees."""
    return _straight(headings(edges, nodes, by), by)


def _straight(h: DataFrame, by: tuple[str, ...]) -> DataFrame:
    a, b = h.select(*by, F.col("u").alias("node"), F.col("v").alias("a"), F.col("heading").alias("ha")), h.select(*by, F.col("u").alias("node"), F.col("v").alias("b"), F.col("heading").alias("hb"))
    return a.join(b, [*by, "node"]).where(F.col("a") < F.col("b")).where(F.abs(angle_between(F.col("ha"), F.col("hb")) - math.pi) < STRAIGHT).select(*by, "node", "a", "b")


def _straight_on(h: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, no, u, v, next_no, turn): half-edges by number, and the one that goes straight on from an intersection; null where a walk ends."""
    numbered = materialise(h.withColumn("no", F.monotonically_increasing_id()))
    here = numbered.where(is_intersection(F.col("v"))).select(*by, "no", F.col("u").alias("from"), F.col("v").alias("at"), F.col("heading").alias("came"))
    there = numbered.select(*by, F.col("no").alias("next_no"), F.col("u").alias("at"), F.col("v").alias("to"), "heading")
    ways = here.join(there, [*by, "at"]).where("to <> from").withColumn("turn", angle_between(F.col("came"), F.col("heading"))).where(F.col("turn") <= BEND)
    best = ways.groupBy("no").agg(F.min_by(F.struct("next_no", "turn"), F.struct("turn", "to")).alias("b")).select("no", "b.*")
    return numbered.join(best, "no", "left")


def walk_on(starts: DataFrame, edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, first, end): from an intersection over its neighbour first, straight on to the first stake that is none.

    At each intersection the walk takes the neighbour it has not visited with the least turn (then the smaller name); at a dead end or a turn
    of over 45 degrees it stops where it is. "Straight on" is a function of the half-edge one comes by, so that all walks double their
    reach in each round. A closed line turns by a full circle in all, of which half a circle at most where it closes: a walk whose turns
    add up to less than half a circle cannot come back to a node. Only the others are walked step by step.
    """
    return _walk_on(starts, headings(edges, nodes, by), by)


def _walk_on(starts: DataFrame, h: DataFrame, by: tuple[str, ...]) -> DataFrame:
    ways = materialise(_straight_on(h, by))
    state = materialise(ways.where("next_no is not null").select("no", F.col("next_no").alias("to"), "turn"))
    while True:
        far = state.select(F.col("no").alias("to"), F.col("to").alias("_to"), F.col("turn").alias("_turn"))
        more = (F.col("turn") < HALF_CIRCLE) & F.col("_to").isNotNull()
        step = state.join(far, "to", "left").select("no", F.when(more, F.col("_to")).otherwise(F.col("to")).alias("to"), F.when(more, F.col("turn") + F.col("_turn")).otherwise(F.col("turn")).alias("turn"), more.alias("moved"))
        state = materialise(step)
        if not state.where("moved").limit(1).count():
            break
    last = ways.select(F.col("no").alias("to"), F.col("v").alias("end"))
    ended = ways.select(*by, F.col("u").alias("node"), F.col("v").alias("first"), "no").join(state.drop("moved"), "no", "left").join(last, "to", "left")
    walked = materialise(starts.select(*by, "node", "first").join(ended.select(*by, "node", "first", "end", "turn"), [*by, "node", "first"]))
    sure = walked.where(F.coalesce("turn", F.lit(0.0)) < HALF_CIRCLE).select(*by, "node", "first", F.coalesce("end", "first").alias("end"))
    winding = walked.where(F.col("turn") >= HALF_CIRCLE).select(*by, "node", "first")
    return sure.unionByName(_step_by_step(winding, ways.select(*by, "u", "v", "heading"), by)) if winding.limit(1).count() else sure


def _step_by_step(starts: DataFrame, h: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, node, first, end), one step a round, with the visited nodes; since no walk visits a node twice, all end."""
    key = [*by, "node", "first"]
    walk = materialise(starts.join(h.select(*by, F.col("u").alias("node"), F.col("v").alias("first"), "heading"), key).select(*key, F.col("first").alias("end"), "heading", F.array("node", "first").alias("seen"), (~is_intersection(F.col("first"))).alias("done")))
    while walk.where("not done").limit(1).count():
        step = walk.where("not done").join(h.select(*by, F.col("u").alias("end"), F.col("v").alias("to"), F.col("heading").alias("next")), [*by, "end"]).where(~F.array_contains("seen", F.col("to"))).withColumn("turn", angle_between(F.col("heading"), F.col("next"))).where(F.col("turn") <= BEND)
        best = step.groupBy(*key).agg(F.min_by(F.struct("to", "next"), F.struct("turn", "to")).alias("b"))
        moved = walk.join(best, key, "left")
        on = ~F.col("done") & F.col("b").isNotNull()
        walk = materialise(moved.select(*key, F.when(on, F.col("b.to")).otherwise(F.col("end")).alias("end"), F.when(on, F.col("b.next")).otherwise(F.col("heading")).alias("heading"), F.when(on, F.concat("seen", F.array("b.to"))).otherwise(F.col("seen")).alias("seen"), (F.col("done") | F.col("b").isNull() | ~is_intersection(F.col("b.to"))).alias("done")))
    return walk.select(*key, "end")


def intersections(edges: DataFrame, nodes: DataFrame, block: str | int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, intersection_stake, baseline_point1, baseline_point2, extension_point1, extension_point2).

    Intersection stakes with exactly one straight pair of neighbours (the baseline) and one other neighbour (the direction).
    Ends are followed to stakes that are no intersections. Seen from the direction point, the baseline keeps its order if the
    cross product of the line of sight and the way to its first point is negative, else it is swapped; equal ends leave the
    second empty. extension_point2 is always empty. block: only intersections of this block. by: columns that tell drawings apart.
    """
    node = [*by, "node"]
    h = materialise(headings(edges, nodes, by))
    own = h.where(is_intersection(F.col("u")))
    straight = _straight(own, by)
    if block is not None:
        straight = straight.where(block_number(F.col("node")) == str(block))
    one = straight.groupBy(*node).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where("n = 1").drop("n")
    other = own.select(*by, F.col("u").alias("node"), "v").join(one, node).where("v <> a and v <> b").groupBy(*node).agg(F.count("*").alias("n"), F.first("v").alias("c")).where("n = 1")
    base = materialise(one.join(other.select(*node, "c"), node))
    starts = base.select(*node, F.explode(F.array("a", "b", "c")).alias("first"))
    ends = materialise(_walk_on(starts, h, by))
    for k in "abc":
        base = base.join(ends.select(*node, F.col("first").alias(k), F.col("end").alias(f"end_{k}")), [*node, k])
    at = lambda name, p: nodes.select(*by, F.col("node").alias(name), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    placed = base.join(at("node", "o"), node).join(at("end_a", "a"), [*by, "end_a"]).join(at("end_c", "c"), [*by, "end_c"])
    dx, dy, vx, vy = F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy"), F.col("ax") - F.col("ox"), F.col("ay") - F.col("oy")
    keep = dx * vy - dy * vx < 0
    p1, p2 = F.when(keep, F.col("end_a")).otherwise(F.col("end_b")), F.when(keep, F.col("end_b")).otherwise(F.col("end_a"))
    return placed.select(*by, F.col("node").alias("intersection_stake"), p1.alias("baseline_point1"), F.when(p1 == p2, "").otherwise(p2).alias("baseline_point2"), F.col("end_c").alias("extension_point1"), F.lit("").alias("extension_point2"))
