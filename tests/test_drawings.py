"""Many drawings at once, rings that share faces or numbers, walks, and assignment in groups of any size."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from landquill.operators import drawing, faces, spatial, traverse

NODE, EDGE, LABEL, PUBLIC = "node string, x double, y double", "u string, v string", "label_id long, number string, x double, y double", "label_id long, label string, x double, y double"


def loop(prefix, x, y, side):
    """A square's nodes and edges."""
    names = [f"{prefix}{k}" for k in range(4)]
    places = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [(n, *p) for n, p in zip(names, places, strict=True)], list(zip(names, [*names[1:], names[0]], strict=True))


def squares(spark, *loops):
    nodes, edges = [], []
    for one in loops:
        n, e = loop(*one)
        nodes += n
        edges += e
    return faces.simple_faces(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE))


def named(rows):
    return sorted((r.parcel_number, frozenset(r.ring)) for r in rows.collect())


def test_a_lone_loop_is_one_unknown_ring(spark):
    simple = squares(spark, ("a", 0.0, 0.0, 10.0), ("b", 100.0, 0.0, 30.0))
    none = spark.createDataFrame([], "parcel_number string, ring array<string>")
    labels = spark.createDataFrame([(1, "道-1", 5.0, 5.0)], PUBLIC)
    assert named(faces.unknown_rings(none, simple, labels)) == [("道-1", frozenset({"a0", "a1", "a2", "a3"}))]


def test_a_label_names_all_faces_around_it(spark):
    simple = squares(spark, ("a", 10.0, 10.0, 5.0), ("b", 0.0, 0.0, 30.0), ("c", 100.0, 0.0, 60.0))
    none = spark.createDataFrame([], "parcel_number string, ring array<string>")
    labels = spark.createDataFrame([(2, "水-2", 12.0, 12.0), (1, "道-1", 12.5, 12.0)], PUBLIC)
    got = faces.unknown_rings(none, simple, labels)
    assert sorted(r.parcel_number for r in got.collect()) == ["道-1", "道-1"]


def test_auxiliary_rings_of_open_numbers(spark):
    simple = squares(spark, ("a", 0.0, 0.0, 10.0), ("b", 20.0, 0.0, 10.0), ("c", 40.0, 0.0, 10.0))
    parcels = spark.createDataFrame([(1, "7", 5.0, 5.0), (2, "8", 6.0, 5.0), (3, "7", 25.0, 5.0), (4, "9", 45.0, 5.0), (5, "10", 46.0, 5.0)], LABEL)
    taken = spark.createDataFrame([("8", ["x", "y", "z", "x"])], "parcel_number string, ring array<string>")
    # 8 has a ring already, so that only 7 is open in a; of 7's two faces the first is taken; c has two open numbers
    assert named(faces.auxiliary_rings(taken, parcels, simple)) == [("7", frozenset({"a0", "a1", "a2", "a3"}))]
    first = faces.auxiliary_rings(taken, parcels, simple).first().ring
    again = spark.createDataFrame([("8", ["x", "y", "z", "x"]), ("other", first)], "parcel_number string, ring array<string>")
    assert named(faces.auxiliary_rings(again, parcels, simple)) == [("7", frozenset({"b0", "b1", "b2", "b3"}))]


def test_auxiliary_rings_start_at_the_face_not_at_its_named_nodes(spark):
    nodes = [("__1", 0.0, 10.0), ("1.2", 10.0, 9.0), ("1.3", 10.0, 0.0), ("1.4", 0.0, 0.0)]
    edges = [("__1", "1.2"), ("1.2", "1.3"), ("1.3", "1.4"), ("1.4", "__1")]
    simple = faces.simple_faces(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE))
    parcels = spark.createDataFrame([(1, "5", 5.0, 5.0)], LABEL)
    none = spark.createDataFrame([], "parcel_number string, ring array<string>")
    assert [r.ring for r in faces.auxiliary_rings(none, parcels, simple).collect()] == [["1.2", "1.3", "1.4", "1.2"]]


def comb(n, teeth):
    """A long loop of nodes, of which every other one below has a triangle outside that touches it in one point."""
    places = [(f"n{k:06d}", float(k), 0.0) for k in range(n)] + [(f"m{k:06d}", float(k), 10.0) for k in range(n)]
    edges = [(f"n{k:06d}", f"n{k + 1:06d}") for k in range(n - 1)] + [(f"m{k:06d}", f"m{k + 1:06d}") for k in range(n - 1)] + [("n000000", "m000000"), (f"n{n - 1:06d}", f"m{n - 1:06d}")]
    for k in range(1, 2 * teeth, 2):
        places += [(f"a{k:06d}", k - 0.3, -1.0), (f"b{k:06d}", k + 0.3, -1.0)]
        edges += [(f"n{k:06d}", f"a{k:06d}"), (f"a{k:06d}", f"b{k:06d}"), (f"b{k:06d}", f"n{k:06d}")]
    return places, edges


def test_long_faces_take_time_in_proportion(spark):
    places, edges = comb(12000, 3000)
    simple = faces.materialise(faces.simple_faces(spark.createDataFrame(edges, EDGE), spark.createDataFrame(places, NODE)))
    parcels = spark.createDataFrame([(1, "5", 50.5, 5.0), (2, "6", 1.0, -0.9)], LABEL)
    none = spark.createDataFrame([], "parcel_number string, ring array<string>")
    began = time.time()
    rings = {r.parcel_number: r.ring for r in faces.auxiliary_rings(none, parcels, simple).collect()}
    assert time.time() - began < 60
    assert len(rings["5"]) == 24001 and set(rings["6"]) == {"n000001", "a000001", "b000001"}
    # the loop and each triangle from inside, and from outside
    assert simple.count() == 2 * 3001


def shuffled_rows(spark):
    """Rows that the session's stages have written to shuffles so far."""
    store, none = spark._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


def grid(n):
    """Places and edges of n times n nodes."""
    nodes = [(f"{r:02d}.{c:02d}", 10.0 * c, 10.0 * r) for r in range(n) for c in range(n)]
    return nodes, [(f"{r:02d}.{c:02d}", f"{r:02d}.{c + 1:02d}") for r in range(n) for c in range(n - 1)] + [(f"{r:02d}.{c:02d}", f"{r + 1:02d}.{c:02d}") for r in range(n - 1) for c in range(n)]


def test_half_edges_find_the_next_ones_without_joins_by_name(spark):
    nodes, edges = grid(30)
    given = faces.materialise(spark.createDataFrame(edges, EDGE)), faces.materialise(spark.createDataFrame(nodes, NODE))
    before = shuffled_rows(spark)
    simple = faces.materialise(faces.simple_faces(*given))
    rows = sum(rows for stage, rows in shuffled_rows(spark).items() if stage not in before)
    assert simple.count() == 29**2 + 1
    assert rows < 15 * 2 * len(edges)


def test_stakes_are_copied_to_few_cells(spark):
    rng = random.Random(6)
    stakes = [(k, str(k), rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(3000)]
    lines = [(k, x - 0.2, y, stakes[k - 1][2], stakes[k - 1][3] + 0.3) for k, _, x, y in stakes]
    given = faces.materialise(spark.createDataFrame(lines, "line_id long, x1 double, y1 double, x2 double, y2 double")), faces.materialise(spark.createDataFrame(stakes, "stake_id long, number string, x double, y double"))
    before = shuffled_rows(spark)
    got = {(r.line_id, r.u, r.v) for r in spatial.line_ends(*given, "number").collect()}
    rows = sum(rows for stage, rows in shuffled_rows(spark).items() if stage not in before)

    def nearest(x, y):
        return min((math.sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), k, name) for k, name, sx, sy in stakes)

    ends = {k: (nearest(x1, y1), nearest(x2, y2)) for k, x1, y1, x2, y2 in lines}
    assert got == {(k, *sorted((a[2], b[2]))) for k, (a, b) in ends.items() if a[0] < 0.5 and b[0] < 0.5} and len(got) == 3000
    # the ends come four times: to the stakes, with what is near, and to their lines
    assert rows < 4 * 2 * len(lines) + 4 * len(stakes)


def test_near_pairs_are_the_same_in_cells_of_any_width(spark):
    rng = random.Random(7)
    left = [(k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for k in range(300)]
    right = [(k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for k in range(300)] + [(900, left[0][1] + 2.0, left[0][2]), (901, left[0][1] + 1.5, left[0][2])]
    want = {(a, b) for a, x, y in left for b, rx, ry in right if math.sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) < 2.0}
    given = spark.createDataFrame(left, "a long, x double, y double"), spark.createDataFrame(right, "b long, rx double, ry double")
    for wide in (1, 2, 4):
        pairs = spatial.near_pairs(*given, 2.0, wide=wide).collect()
        assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want


def test_labels_are_shuffled_once_to_their_faces(spark):
    """Not once for each face whose box touches a label's cell."""
    n, labels = 12, 3000
    nodes, edges = grid(n)
    simple = faces.materialise(faces.simple_faces(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)))
    rng = random.Random(3)
    parcels = faces.materialise(spark.createDataFrame([(k, str(k), rng.uniform(0, 110), rng.uniform(0, 110)) for k in range(labels)], LABEL))
    before = shuffled_rows(spark)
    assert faces.parcel_rings(parcels, simple).count() == (n - 1) ** 2
    assert sum(rows for stage, rows in shuffled_rows(spark).items() if stage not in before) < 4 * labels


def test_faces_of_any_length_hold_the_points_that_a_plain_count_finds(spark, monkeypatch):
    """Faces of few sides, of many, and of many in one row of cells, in two drawings at the same place."""
    rng, shapes, points = random.Random(4), [], []
    for sheet in (1, 2):
        for k, (n, size) in enumerate(((3, 5.0), (4, 60.0), (12, 9.0), (150, 200.0), (300, 25.0), (2000, 60.0))):
            x, y = rng.uniform(-40, 40), rng.uniform(-40, 40)
            ring = [(x + size * rng.uniform(0.4, 1.0) * math.cos(t), y + size * rng.uniform(0.4, 1.0) * math.sin(t)) for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]
            shapes.append((sheet, f"f{k}", [(f"n{j}", *p) for j, p in enumerate(ring)], 100.0 * (k % 5)))
        points += [(sheet, k, rng.uniform(-120, 120), rng.uniform(-120, 120), f"p{k}") for k in range(400)]
    simple = spark.createDataFrame(shapes, "sheet int, face_id string, points array<struct<node: string, x: double, y: double>>, area double")
    dots = spark.createDataFrame(points, "sheet int, point_id long, x double, y double, name string")

    def holds(ring, px, py):
        sides = zip(ring, [*ring[1:], ring[0]], strict=True)
        return sum((a[2] > py) != (b[2] > py) and px < (b[1] - a[1]) * (py - a[2]) / (b[2] - a[2]) + a[1] for a, b in sides) % 2 == 1

    want = {(s, k, name, face, area) for s, k, x, y, name in points for sheet, face, ring, area in shapes if s == sheet and holds(ring, x, y)}
    least = {(s, k, name, min((a, f) for s2, k2, _, f, a in want if (s2, k2) == (s, k))[1]) for s, k, name, _, _ in want}
    for few in (spatial.FEW_SIDES, 1 << 20):
        monkeypatch.setattr(spatial, "FEW_SIDES", few)
        got = spatial.faces_around(dots, simple, 20.0, ("sheet",), ("name",)).collect()
        assert len(got) == len(want) and {(r.sheet, r.point_id, r.name, r.face_id, r.area) for r in got} == want
        assert {(r.sheet, r.point_id, r.name, r.face_id) for r in spatial.smallest_face(dots, simple, 20.0, ("sheet",), ("name",)).collect()} == least


def test_small_files_are_not_broadcast_by_their_size(spark):
    table = faces.materialise(spark.range(1000).selectExpr("id", "repeat('x', 20) as name"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1" and spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") != "-1"
    assert "BroadcastHashJoin" not in table.join(table.withColumnRenamed("name", "other"), "id")._jdf.queryExecution().sparkPlan().toString()


def drawn(drawing_id, scale, shift, text):
    """Entities of a strip of three squares with numbers, parcels and a public label; the same names in every drawing."""
    kind, line = ("TEXT", "LINE") if text else ("MTEXT", "LWPOLYLINE")
    rows, k = [], 0
    places = [(10.0 * i * scale, 10.0 * j * scale) for i in range(4) for j in range(2)]
    for x, y in places:
        rows.append((k, "CIRCLE", "1", x, y, None, None, 2.5 if text else 0.25, None))
        rows.append((100 + k, kind, "1", x + 0.4, y + shift, None, None, None, f"{'-' if k == 3 else ''}1.{k}"))
        k += 1
    pairs = [(a, a + 1) for a in range(0, 8, 2)] + [(a, a + 2) for a in range(6)]
    rows += [(200 + n, line, "2", *places[a], *places[b], None, None) for n, (a, b) in enumerate(pairs)]
    rows += [(300, kind, "3", 5.0 * scale, 5.0 * scale, None, None, None, "3-1"), (301, kind, "3", 5.5 * scale, 5.0 * scale, None, None, None, "田"), (302, kind, "3", 25.0 * scale, 5.0 * scale, None, None, None, "道-1")]
    return [(drawing_id, *r) for r in rows]


def parsed(spark, rows):
    schema = "drawing_id int, ord long, etype string, layer string, x1 double, y1 double, x2 double, y2 double, radius double, text string"
    return drawing.parse_entities(spark.createDataFrame(rows, schema).withColumn("n_points", F.when(F.col("etype") == "LWPOLYLINE", 2)))


def shown(got):
    tables = [got.stakes, got.lines, got.parcels, got.public_labels, got.edges, drawing.drawing_rings(got), drawing.drawing_intersections(got)]
    return [sorted((tuple(map(str, r)) for r in t.collect())) for t in tables]


def test_drawings_together_give_what_each_gives_alone(spark):
    sheets = [drawn(1, 1.0, 0.3, False), drawn(2, 10.0, 6.0, True), drawn(3, 1.0, 0.2, False)]
    alone = [shown(parsed(spark, s)) for s in sheets]
    together = shown(parsed(spark, sum(sheets, [])))
    for k, table in enumerate(together):
        assert table == sorted(sum((a[k] for a in alone), []))
    assert all(len(a[5]) == 3 for a in alone)


def cost_of(rows):
    return sum(rows.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_auction_equals_the_local_solver(spark, seed):
    """A dense patch of texts and stakes, more texts than stakes, on a regular grid and at random."""
    rng = random.Random(seed)
    left = [(i, 1.5 * (i % 9), 1.5 * (i // 9), "p") if seed == 1 else (i, rng.uniform(0, 14), rng.uniform(0, 14), rng.choice("pq")) for i in range(72)]
    right = [(i, 1.5 * (i % 9) + 0.75, 1.5 * (i // 9) + 0.5, "p") if seed == 1 else (i, rng.uniform(0, 14), rng.uniform(0, 14), rng.choice("pq")) for i in range(60)]
    a = spark.createDataFrame(left, "left_id long, x double, y double, layer string")
    b = spark.createDataFrame(right, "right_id long, rx double, ry double, r_layer string")
    layers = {i: r[3] for i, r in enumerate(left)}, {i: r[3] for i, r in enumerate(right)}

    def total(df):
        rows = df.collect()
        assert len({r.left_id for r in rows}) == len({r.right_id for r in rows}) == len(rows)
        return len(rows), sum(r.d * (0.8 if layers[0][r.left_id] == layers[1][r.right_id] else 1) for r in rows)

    n, cost = total(spatial.assign(a, b, 3.0, local=0))
    m, least = total(spatial.assign(a, b, 3.0, local=10_000))
    assert n == m and abs(cost - least) < 1e-5


def test_assignment_by_drawing(spark):
    rng = np.random.default_rng(4)
    rows = [(d, i, float(x), float(y), "p") for d in (1, 2) for i, (x, y) in enumerate(rng.uniform(0, 20, (40, 2)))]
    other = [(d, i, float(x), float(y), "p") for d in (1, 2) for i, (x, y) in enumerate(rng.uniform(0, 20, (40, 2)))]
    a = spark.createDataFrame(rows, "drawing_id int, left_id long, x double, y double, layer string")
    b = spark.createDataFrame(other, "drawing_id int, right_id long, rx double, ry double, r_layer string")
    both = {tuple(r) for r in spatial.assign(a, b, 3.0, ("drawing_id",)).collect()}
    each = {tuple(r) for d in (1, 2) for r in spatial.assign(a.where(F.col("drawing_id") == d), b.where(F.col("drawing_id") == d), 3.0, ("drawing_id",)).collect()}
    assert both == each and both


def test_a_long_chain_is_walked_in_few_rounds(spark, monkeypatch):
    n = 3000
    chain = spark.range(n).select(F.when(F.col("id") == n - 1, "1.9").otherwise(F.concat(F.lit("-1."), F.col("id").cast("string"))).alias("node"), F.col("id").cast("double").alias("x"), (F.col("id") % 2 * 0.01).alias("y"))
    edges = spark.range(n - 1).select(F.concat(F.lit("-1."), F.col("id").cast("string")).alias("u"), F.when(F.col("id") == n - 2, "1.9").otherwise(F.concat(F.lit("-1."), (F.col("id") + 1).cast("string"))).alias("v"))
    rounds = []
    write = traverse.materialise
    monkeypatch.setattr(traverse, "materialise", lambda df: (rounds.append(1), write(df))[1])
    start = spark.createDataFrame([("-1.0", "-1.1")], "node string, first string")
    straight = chain.withColumn("y", F.lit(0.0))
    assert [r.end for r in traverse.walk_on(start, edges, straight).collect()] == ["1.9"] and len(rounds) < 20


def test_winding_walks_do_not_visit_a_node_twice(spark):
    # a spiral of intersections that runs into its own start
    n = 16
    places = [(f"-1.{k:02}", math.cos(k * math.pi / 8) * 10, math.sin(k * math.pi / 8) * 10) for k in range(n)]
    nodes = spark.createDataFrame(places, NODE)
    edges = spark.createDataFrame([(places[k][0], places[(k + 1) % n][0]) for k in range(n)], EDGE)
    start = spark.createDataFrame([("-1.00", "-1.01")], "node string, first string")
    assert [r.end for r in traverse.walk_on(start, edges, nodes).collect()] == ["-1.15"]


def test_doublings_leave_short_cycles_behind(spark, monkeypatch):
    """Cycles of every length get the same names and places as a plain walk gives; late doublings only have the long ones' rows."""
    rng, step, start = random.Random(5), {}, 0
    names = list(range(3000))
    rng.shuffle(names)
    for n in (*range(1, 40), 300, *[4] * 200, 700):
        ids = names[start : start + n]
        start += n
        step |= dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    want = {}
    for i in step:
        if i not in want:
            walk = [i]
            while step[walk[-1]] != i:
                walk.append(step[walk[-1]])
            at = walk.index(min(walk))
            want |= {x: (min(walk), k) for k, x in enumerate([*walk[at:], *walk[:at]])}
    counts, write = [], faces.materialise
    monkeypatch.setattr(faces, "materialise", lambda df: (counts.append(write(df)), counts[-1])[1])
    got = faces.cycles(spark.createDataFrame(list(step.items()), "id long, next long"))
    assert {r.id: (r.face, r.place) for r in got.collect()} == want and got.count() == len(step)
    assert counts[-1].count() <= 1000 < len(step)
