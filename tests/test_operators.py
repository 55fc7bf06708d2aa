"""Operators against sequential models, known values and invariants."""

import itertools
import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from landquill.functions import text as tx
from landquill.operators import boxes, diff, drawing, entities, faces, graph, layout, ordered, raster, reconcile, sequence, spatial, traverse
from landquill.operators.graph import components, many_parts, materialise, release
from landquill.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("function", "value", "want"),
    [
        (tx.parcel_key, "２３２５－１", "2325番1"),
        (tx.parcel_key, "895番", "895"),
        (tx.parcel_key, "12番の3", "12番3"),
        (tx.parcel_number, "1-2-3", "1番2-3"),
        (tx.area, "514・20", "514.2"),
        (tx.area, "85.00", "85"),
        (tx.area, "99", "99"),
        (tx.area, None, ""),
        (tx.decode_codes, "<00009AD9>橋", "髙橋"),
        (tx.decode_codes, "<00003042>", "あ"),
        (tx.decode_codes, "<00000000>", "〓"),
        (tx.decode_codes, "<0000D800>x<0001F600>", "〓x😀"),
        (tx.nfkc, "ｶﾞｽ１㎡", "ガス1m2"),
        (tx.nfkc, "plain", "plain"),
        (tx.normalize, " 水戸　 市\t１ ", "水戸 市 1"),
        (tx.without_marker, " （空欄） ", ""),
        (tx.without_marker, "山林", "山林"),
        (tx.old_form_fold, "髙澤シヨ", "高沢ショ"),
        (tx.block_number, "14.235", "14"),
        (tx.block_number, "-13.298", "13"),
        (tx.block_number, "交16.473", "16"),
        (tx.block_number, "計16.5002", "16"),
        (tx.block_number, "x", None),
        (tx.classify, "-13.298", "intersection_stake"),
        (tx.classify, "交16.4", "intersection_stake"),
        (tx.classify, "既1.2", "existing_stake"),
        (tx.classify, "１.２", "stake"),
        (tx.classify, "R5.1.200", "survey_code"),
        (tx.classify, "12-3\nx", "parcel_number"),
        (tx.classify, "水-1", "public_land"),
        (tx.classify, "ため池", "land_use"),
        (tx.classify, "", "other"),
        (tx.clean_mtext, "{\\fMS|b0;12\\C3;-3}", "12-3"),
        (tx.strip_old_marks, "【山林】", "山林"),
        (tx.natural_key, "12番の3-4", [12, 3, 4]),
        (tx.natural_key, "x1", None),
    ],
)
def test_texts(spark, function, value, want):
    assert one(spark, value, function) == want


def test_area_cross_check(spark):
    rows = spark.createDataFrame([("110.90", "110"), ("110.90", "1109"), ("110.90", "11090"), ("99", "98")], "s string, r string")
    assert [r[0] for r in rows.select(tx.cross_checked_area(F.col("s"), F.col("r"))).collect()] == ["110.9", "110.9", "11090", "98"]


def model_merge(lines, across=False):
    """A plain sequential reading of one file's lines."""
    out, last, page, row = [], None, None, 0
    for i, (idx, p, entry, parcel, area, owner) in enumerate(lines):
        row = row + 1 if p == page else 0
        page = p
        if entry == "続更新":
            follow = next((x for x in lines[i + 1 : i + 3] if x[2] not in ("続", "続更新", "")), None)
            if row > 0 or (follow and follow[4] == area):
                continue
            if last and area:
                last["area"] = area
                for m in reversed(out):
                    if m[3] == last["parcel"]:
                        m[4] = area
                        break
            continue
        if entry == "続表題":
            if last:
                last["parcel"] = last["parcel"] or parcel
                last["area"] = last["area"] or area
                for m in reversed(out):
                    if m[2] == last["num"] and not m[3]:
                        m[3], m[4] = last["parcel"], last["area"]
                        break
                out.append([idx, p, last["num"], last["parcel"], last["area"], owner])
            continue
        if entry == "続":
            seen, twice = False, False
            for x in lines[i + 1 : i + 10]:
                if x[2].isdigit():
                    seen = True
                elif x[2] == "続" and seen and x[5] == owner and owner:
                    twice = True
            if twice:
                continue
            out.append([idx, p, last["num"], last["parcel"], last["area"], owner] if last else [idx, p, entry, parcel, area, owner])
            continue
        last = {"num": entry, "parcel": parcel, "area": area}
        out.append([idx, p, entry, parcel, area, owner])
    return [tuple(r) for r in out]


def test_merge_equals_a_sequential_reading(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for file in range(60):
        lines, number = [], 0
        for i in range(rng.randint(1, 14)):
            entry = rng.choice(["n", "n", "続", "続", "続更新", "続表題"])
            number += entry == "n"
            full = entry in ("続表題", "n")
            parcel = f"{file}番{number}" if entry == "続表題" or (full and rng.random() < 0.6) else ""
            area = rng.choice(["", "10", "20"]) if entry != "続" else ""
            lines.append((i, i // 4, str(number) if entry == "n" else entry, parcel, area, rng.choice(["A", "B", "C"])))
        rows += [(file, *x) for x in lines]
        want[file] = model_merge(lines)
    df = spark.createDataFrame(rows, "file_no int, line_idx long, page int, entry string, parcel_no string, area string, owner_name string")
    got = {f: [] for f in want}
    for r in sequence.merge_lines(df, across=False).orderBy("file_no", "line_idx").collect():
        got[r.file_no].append((r.line_idx, r.page, r.entry, r.parcel_no, r.area, r.owner_name))
    assert got == want


def test_number_gaps(spark):
    df = spark.createDataFrame([(0, str(n), i) for i, n in enumerate([1, 2, 2, 5, 12])] + [(0, "続", 9)], "file_no int, entry string, line_idx long")
    got = {tuple(r.missing): r.kind for r in sequence.number_gaps(df).collect()}
    assert got == {(3, 4): "small", (6, 7, 8, 9, 10, 11): "large"}


def test_diff_of_equal_tables_is_empty_and_mirrors(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (2, "z", 3.0)], "id int, s string, d double")
    b = spark.createDataFrame([(1, "X", 1.0), (3, "y", 2.0)], "id int, s string, d double")
    assert diff.keyed_diff(a, a).collect() == []
    ab, ba = (sorted((r.id, r.kind) for r in diff.keyed_diff(x, y).collect()) for x, y in ((a, b), (b, a)))
    swap = {"only_a": "only_b", "only_b": "only_a", "changed": "changed"}
    assert ba == sorted((i, swap[k]) for i, k in ab) and ("1", "changed") in ab
    assert diff.guess_keys(["width", "name"]) == ["width"] and diff.guess_keys(["a", "b"]) == ["a", "b"]
    assert diff.set_diff(a.select("id"), b.select("id")).count() == 2
    assert not diff.has_differences({"t": a}, {"t": a}) and diff.has_differences({"t": a}, {"t": b}) and diff.has_differences({"t": a}, {"t": a, "u": b})
    # no column reads as a key: all are; columns may have any name
    p, q = (spark.createDataFrame(x, "p int, q int, r int") for x in ([(1, 2, 3)], [(1, 2, 4)]))
    assert sorted(map(tuple, diff.keyed_diff(p, q).collect())) == [("1", "2", "3", "only_a", "", ""), ("1", "2", "4", "only_b", "", "")]
    p, q = (spark.createDataFrame(x, "a int, b int, value string") for x in ([(1, 2, "x|y")], [(1, 2, "z")]))
    assert [tuple(r) for r in diff.keyed_diff(p, q, ["a", "b"]).collect()] == [("1", "2", "changed", "value", "x|y → z")]
    assert [r.value for r in diff.keyed_diff(p, q.limit(0), ["a", "b"]).select("kind", F.col("value")).collect()] == ['{"value":"x|y"}']
    rows, tables = diff.snapshot_diff({"t": a, "u": a}, {"t": b, "v": b})
    assert tables == {"common": ["t"], "only_a": ["u"], "only_b": ["v"]} and rows.count() == len(ab)


def test_nearest_assignment_and_edges(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(120)]
    other = [(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(80)]
    left, right = spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(other, "rid long, rx double, ry double")
    got = {r.id: r.rid for r in spatial.nearest_within(left, right, 2.0, "id", "rid", ("rid",)).collect()}
    for i, x, y in pts:
        d, j = min((math.hypot(x - a, y - b), j) for j, a, b in other)
        assert got[i] == (j if d < 2.0 else None)
    for _ in range(30):
        n = rng.randint(1, 6)
        cost = np.array([[rng.random() for _ in range(n)] for _ in range(n)])
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(cost[np.arange(n), spatial.assignment(cost)].sum() - best) < 1e-9
    a = spark.createDataFrame([(0, 0.0, 0.0, "p"), (1, 1.0, 0.0, "p")], "left_id long, x double, y double, layer string")
    b = spark.createDataFrame([(0, 0.4, 0.0, "q"), (1, -3.0, 0.0, "q")], "right_id long, rx double, ry double, r_layer string")
    assert sorted((r.left_id, r.right_id) for r in spatial.assign(a, b).collect()) == [(0, 1), (1, 0)]
    plan = spatial.nearest_within(left, right, 2.0, "id", "rid", ("rid",))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def grid(w, h):
    nodes = [(f"{x}.{y}", float(x), float(y)) for x in range(w + 1) for y in range(h + 1)]
    edges = [(f"{x}.{y}", f"{x + 1}.{y}") for x in range(w) for y in range(h + 1)] + [(f"{x}.{y}", f"{x}.{y + 1}") for x in range(w + 1) for y in range(h)]
    return nodes, edges


def test_faces_of_a_grid(spark):
    nodes, edges = grid(3, 2)
    n, e = spark.createDataFrame(nodes, "node string, x double, y double"), spark.createDataFrame(edges, "u string, v string")
    rows = faces.faces(e, n).collect()
    assert sorted(r.area for r in rows) == [-1.0] * 6 + [6.0] and abs(sum(r.area for r in rows)) < 1e-9
    assert sum(r.n for r in rows) == 2 * len(edges)
    assert len(nodes) - len(edges) + len(rows) == 2
    labels = spark.createDataFrame([(1, "1-1", 0.5, 0.5), (2, "1-2", 0.6, 0.6), (3, "9", 2.5, 1.5)], "label_id long, number string, x double, y double")
    rings = {r.parcel_number: r.ring for r in faces.parcel_rings(labels, faces.simple_faces(e, n)).collect()}
    assert set(rings) == {"1-1", "9"} and rings["1-1"] == ["0.1", "1.1", "1.0", "0.0", "0.1"]
    square = spark.createDataFrame([([("a", 0.0, 0.0), ("b", 0.0, 1.0), ("c", 1.0, 1.0), ("d", 1.0, 0.0)],)], "p array<struct<node:string,x:double,y:double>>")
    assert square.select(faces.northwest_ring(F.col("p"))).first()[0][0] == "b"
    walk = spark.createDataFrame([(["a", "b", "c", "d", "b", "e"],)], "w array<string>")
    assert sorted(map(sorted, walk.select(faces.split_at_repeats("w")).first()[0])) == [[0, 1, 5], [1, 2, 3]]


def test_intersections(spark):
    nodes = spark.createDataFrame([("-1.1", 0.0, 0.0), ("1.2", -1.0, 0.0), ("1.3", 1.0, 0.0), ("1.4", 0.0, -1.0)], "node string, x double, y double")
    edges = spark.createDataFrame([("-1.1", "1.2"), ("-1.1", "1.3"), ("-1.1", "1.4")], "u string, v string")
    assert [tuple(r) for r in traverse.intersections(edges, nodes).collect()] == [("-1.1", "1.3", "1.2", "1.4", "")]
    chain = spark.createDataFrame([("-1.1", 0.0, 0.0), ("-1.2", 1.0, 0.0), ("-1.3", 2.0, 0.1), ("1.4", 3.0, 0.1)], "node string, x double, y double")
    links = spark.createDataFrame([("-1.1", "-1.2"), ("-1.2", "-1.3"), ("-1.3", "1.4")], "u string, v string")
    start = spark.createDataFrame([("-1.1", "-1.2")], "node string, first string")
    assert [r.end for r in traverse.walk_on(start, links, chain).collect()] == ["1.4"]


def dem(spark, values):
    return spark.createDataFrame([(r, c, v) for r, row in enumerate(values) for c, v in enumerate(row)], "row int, col int, elev double")


def test_raster(spark):
    point = spark.createDataFrame([(35.68, 139.77, 14)], "lat double, lon double, zoom int")
    assert tuple(point.select(raster.tile_x(F.col("lon"), F.col("zoom")), raster.tile_y(F.col("lat"), F.col("zoom"))).first()) == (14553, 6451)
    rng = np.random.default_rng(2)
    z = rng.uniform(0, 50, (7, 9))
    gy, gx = np.gradient(z, 4.0, 5.0)
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    for r in raster.slope(dem(spark, z.tolist()), 5.0, 4.0).collect():
        assert abs(r.slope - want[r.row, r.col]) < 1e-9
    ramp = raster.slope(dem(spark, [[float(c) for c in range(10)] for _ in range(10)]), 5.0, 5.0)
    assert abs(ramp.where("row = 5 and col = 5").first().slope - math.degrees(math.atan(1 / 5))) < 1e-9
    flat = raster.slope(dem(spark, [[3.0] * 10 for _ in range(10)]), 5.0, 5.0)
    assert flat.agg(F.max("slope")).first()[0] < 0.1
    stats = raster.zonal_stats(spark, flat, [(139.0, 35.9), (139.1, 35.9), (139.1, 36.0), (139.0, 36.0)], (36.0, 35.9, 139.0, 139.1), 25.0).collect()
    assert len(stats) == 6 and abs(sum(r.percent for r in stats) - 100) < 0.1
    none = raster.zonal_stats(spark, flat, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], (36.0, 35.9, 139.0, 139.1), 25.0).collect()
    assert [r.percent for r in none] == [0.0] * 6
    degrees = spark.createDataFrame([(float(v),) for v in (2, 10, 20, 30, 40, 50, 5, 15, 25, 35, 45, 90)], "s double")
    assert [r[0] for r in degrees.select(raster.slope_class(F.col("s"))).collect()] == [0, 1, 2, 3, 4, 5, 1, 2, 3, 4, 5, -1]
    tile = spark.createDataFrame([(0, 0, 0, "1,e,x\n2")], "tx int, ty int, prio int, body string")
    assert sorted((r.row, r.col, r.elev) for r in raster.tile_pixels(tile, 2).collect()) == [(0, 0, 1.0), (0, 1, None), (1, 0, 2.0), (1, 1, None)]


def test_text_rows_use_the_first_box(spark):
    df = spark.createDataFrame([(1, i, str(i), 0.5, 0.0, float(y)) for i, y in enumerate([0, 10, 20, 30])], "page int, box_id long, text string, conf double, x_left double, y_top double")
    assert [r.text for r in boxes.group_text_rows(df).orderBy("row_no").collect()] == ["0 1", "2 3"]


def test_layout(spark):
    rings = spark.createDataFrame([(1, "5-1", [f"{i % 2 + 1}.{i}" for i in range(101)]), (2, "5-1", ["3.1", "3.2", "3.1"])], "ring_id long, parcel_number string, ring array<string>")
    cells = {(r.sheet, r.row, r.col): r.value for r in layout.ring_layout(rings).collect()}
    assert cells[("5-1", 5, 1)] == "1.0" and cells[("5-1", 29, 10)] == "2.99" and cells[("5-1_2", 5, 1)] == "1.100"
    assert cells[("5-1(2)", 3, 0)] == "3" and cells[("5-1", 3, 6)] == "5-1" and cells[("5-1", 3, 0)] == "1"


def test_reconcile(spark):
    owner = "owners array<struct<name:string,address:string>>"
    source = spark.createDataFrame([("1", "甲", "宅地", "110.90", ["山林"], [("乙", "東京")], "f"), ("2", "", "田", "5", [], [], "f"), ("3", "丙", "畑", "", None, None, "f")], f"key string, location string, land_use string, area string, old_land_uses array<string>, {owner}, file string")
    read = spark.createDataFrame([("1", "丁", "山林", "1109", [("乙", ""), ("丙", "")], "8"), ("2", "", "畑", "5.0", [], "9"), ("4", "", "田", "1", [], "")], f"key string, location string, land_use string, area string, {owner}, page string")
    full = reconcile.reconcile(source, read)
    got = {r.key: r for r in full.collect()}
    pick = lambda k: tuple(got[k][c] for c in ("status", "location", "land_use_change", "area_change", "land_use", "area"))
    assert pick("1") == ("both", "丁", "corrected", "corrected", "宅地", "110.90") and (got["1"].read_owners, got["1"].read_owner_count) == ("乙, 丙", 2)
    assert pick("2") == ("both", "", "changed", "", "畑", "5") and pick("3")[:2] == ("source_only", "丙") and pick("4")[0] == "read_only"
    people = [df.select("key", F.explode("owners").alias("o")).select("key", "o.*") for df in (source, read)]
    rows = [(r.key, r.item, r.note) for r in reconcile.changes(full, reconcile.match_owners(*people)).orderBy("key", "item_ord").collect()]
    assert rows == [("1", "地目（OCR補正）", ""), ("1", "地積（小数点補正）", "小数点の縦点線がOCRで認識されなかった可能性"), ("1", "所有者（追加）", ""), ("2", "地目", "")]
    assert [(r.category, r.source) for r in reconcile.unmatched(full).orderBy("key").collect()] == [("照合元のみ", "f"), ("OCRのみ", "PDF p.?")]
    lines = spark.createDataFrame([(0, "1", "f", "甲", "5番", "田", "1", "東京都港区", "", "佐藤"), (1, "2", "f", "", "５番", "畑", "", "", "", ""), (2, "2", "f", "", "5", "", "", "鈴木", "", ""), (3, "2", "f", "", "東京1番地", "", "", "x", "", "")], "line_idx long, page string, file string, location string, parcel_no string, land_use string, area string, addr string, share string, name string")
    (one,) = reconcile.read_properties(lines).collect()
    assert (one.key, one.location, one.land_use, one.page, [(o.address, o.name) for o in one.owners]) == ("5", "甲", "田", "1", [("東京都港区", "佐藤"), ("", "鈴木")])
    owners = [spark.createDataFrame(x, "key string, name string") for x in ([("1", "髙橋 一"), ("1", "佐藤"), ("1", "乙")], [("1", "高橋一"), ("1", "佐 藤"), ("1", "丙")])]
    assert sorted((r.kind, r.source_name, r.read_name) for r in reconcile.match_owners(*owners).collect()) == [("消失", "乙", ""), ("異体字差異", "髙橋 一", "高橋一"), ("追加", "", "丙")]
    row = spark.createDataFrame([("a,b",), (",".join(map(str, range(11))),)], "x string").select(reconcile.repair_arity(F.col("x"))).collect()
    assert [len(r[0]) for r in row] == [9, 9] and row[1][0][8] == "8,9,10"
    drift = spark.createDataFrame([("水戸市1番地", "平成2年1月1日", ""), ("鈴木", "", ""), ("東京都港区", "佐藤", "昭和1年")], "addr string, share string, name string")
    assert [(r.addr, r.share, r.name) for r in reconcile.repair_owner(drift).collect()] == [("水戸市1番地", "平成2年1月1日", ""), ("", "", "鈴木"), ("東京都港区", "", "佐藤")]


def test_registry_files(spark, tmp_path):
    text = "1,物件情報,土地,現存,大字,1-1,777\n,所在,北市大字甲\n,表示履歴,１番１,,【山林】,100・0\n,表示履歴,,,宅地,110.90\n,所有権,東京都,持分2分の1,髙橋,,登記,第1号\n"
    (tmp_path / "a_001_BM.csv").write_bytes(text.encode("cp932"))
    (tmp_path / "b_001_BM.csv").write_bytes(text.replace("１番１", "2番").encode("utf-8-sig") + "♥".encode())
    (tmp_path / "c.txt").write_text("no")
    rows = files.csv_rows(files.registry_files(spark, str(tmp_path)))
    assert {r.file for r in rows.collect()} == {"a_001_BM.csv", "b_001_BM.csv"}
    props = {r.file: r for r in diff.tracked(diff.rollup_records(rows)).collect()}
    a = props["a_001_BM.csv"]
    assert (a.key, a.location, a.land_use, a.area, a.old_land_uses) == ("北市大字甲|1番1", "北市大字甲", "宅地", "110.90", ["山林"])
    assert [tuple(o) for o in a.owners] == [("東京都", "持分2分の1", "髙橋", "登記", "第1号")]
    assert (a.kind, a.status, a.real_estate_no, a.history) == ("土地", "現存", "777", ["1番1|【山林】|100・0||", "|宅地|110.90||"])
    with pytest.raises(ValueError, match="none of"):
        files.decode(b"\x81 ")
    assert files.decode(b"\x81\x7c").encode("utf-8") == "－".encode()
    out = diff.registry_diff(*[diff.tracked(diff.rollup_records(rows.where(F.col("file") == f))) for f in props])
    files.write_diff(out, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert tuple(back.columns) == files.DIFF_HEADERS and sorted((r["差分種別"], r["地番"], r["項目"]) for r in back.collect()) == [("削除", "1番1", "物件"), ("追加", "2番", "物件")]
    pairs = diff.registry_diff_all_pairs(diff.rollup_records(rows))
    assert [tuple(r) for r in pairs.collect()] == [("a_001_BM.csv", "b_001_BM.csv", 1, 1, 2, 1, 1, 0)]


def test_drawing_tags(spark):
    tags = ["0", "CIRCLE", "8", "L", "10", "1.5", "20", "2", "40", "0.25", "0", "LWPOLYLINE", "10", "0", "20", "0", "10", "3", "20", "4", "0", "MTEXT", "1", "1.830", "10", "1.4", "20", "2.1", "0", "SOLID"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "drawing_id int, line_idx long, text string")
    ents = files.entities_from_tags(lines)
    got = {r.etype: r for r in ents.collect()}
    assert set(got) == {"CIRCLE", "LWPOLYLINE", "MTEXT"} and got["CIRCLE"].radius == 0.25 and (got["LWPOLYLINE"].x2, got["LWPOLYLINE"].n_points) == (3.0, 2)
    assert entities.detect_format(ents).first().format == "mtext" and entities.detect_format(ents.where("etype <> 'LWPOLYLINE'")).first().format == "text" and entities.stakes(ents).count() == 1
    assert [(r.category, r.number) for r in entities.stake_texts(ents).collect()] == [("stake", "1.830")]


def test_registry_dialects(spark):
    rows = [["7", "物件情報", "土地", "現存", "甲", "3-4", "9", "", "", "乙", "55"], ["", "所在", "丙"], ["", "所在", ""], ["", "表示履歴", "", "", "[田]", "5"], ["", "表示履歴", "１２−３番", "", "【畑】", "6"], ["x"], ["", "所有者", ""], ["", "所有者", "丁"], ["", "所有権", "（空）", "", ""]]
    df = spark.createDataFrame([("f", i, r) for i, r in enumerate(rows)], "file string, line_idx long, fields array<string>")
    new, old = diff.rollup_records(df).first(), diff.rollup_records(df, dialect="source").first()
    assert (new.location, new.land_use, new.area, new.city_code, new.old_land_uses) == ("甲乙", "", "6", "55", ["田", "畑"])
    assert (old.location, old.land_use, old.area, old.old_land_uses) == ("丙", "田", "6", ["畑"])
    assert [o.name for o in new.owners] == ["丁", ""] and [o.name for o in old.owners] == ["丁"]
    assert diff.rollup_records(df.where("line_idx < 1")).first().parcel_no == "3番4" and diff.rollup_records(df.where("line_idx between 1 and 3")).count() == 0


def test_early_dialects(spark):
    lines = [(0, "1", "1番1", "10", "A"), (1, "続", "", "", "B"), (2, "続更新", "", "20", ""), (3, "続", "", "", "C"), (4, "続更新", "", "", "")]
    df = spark.createDataFrame([(0, 0, *x) for x in lines], "file_no int, page int, line_idx long, entry string, parcel_no string, area string, owner_name string")
    got = [tuple(r)[2:] for r in sequence.merge_lines(df, checked=False).orderBy("line_idx").collect()]
    assert got == [(0, "1", "1番1", "10", "A"), (1, "1", "1番1", "20", "B"), (3, "1", "1番1", "20", "C")]
    row = spark.createDataFrame([(["続", "東京都", "2分の1", "鈴木", "昭和1年"],), (["3", "大字", "5番"],)], "fields array<string>")
    assert [tuple(r) for r in sequence.line_columns(row, early=True).collect()] == [("続", "", "", "", "", "東京都", "2分の1", "鈴木", "昭和1年"), ("3", "大字", "5番", "", "", "", "", "", "")]
    drift = spark.createDataFrame([("東京都", "鈴木", "昭和1年", "第1号"), ("東京都", "持分2分の1", "佐藤", "x")], "addr string, share string, name string, registered string")
    assert [tuple(r) for r in reconcile.repair_owner_v1(drift).collect()] == [("東京都", "", "鈴木", "昭和1年"), ("東京都", "持分2分の1", "佐藤", "x")]


def test_text_format_with_one_large_circle(spark):
    rows = [("CIRCLE", "1", 0.0, 0.0, None, None, 848.72, None), ("CIRCLE", "_f-8_", 9.0, 0.0, None, None, 1.0, None), ("TEXT", "1", 3000.0, 0.0, None, None, None, "1.1"), ("TEXT", "_9-0_", 1.0, 0.0, None, None, None, "1.2"), ("TEXT", "2", 50.0, 0.0, None, None, None, "7-1"), ("TEXT", "2", 50.0, 9000.0, None, None, None, "田")]
    ents = spark.createDataFrame([(1, i, e, *r) for i, (e, *r) in enumerate(rows)], "drawing_id int, ord long, etype string, layer string, x1 double, y1 double, x2 double, y2 double, radius double, text string").withColumn("n_points", F.lit(None).cast("long"))
    got = drawing.parse_entities(ents)
    assert [tuple(r) for r in got.stakes.select("stake_id", "number").collect()] == [(0, "1.1")]
    assert [(r.number, r.land_use, r.owner) for r in got.parcels.collect()] == [("7-1", "田", None)]


def test_running_values_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 3)
    rng = random.Random(3)
    rows = [(f, i, rng.randint(0, 3), rng.choice([None, *range(9)])) for f in "ab" for i in range(rng.randint(9, 20))]
    df = spark.createDataFrame(rows, "file string, i long, v int, m int")
    got = ordered.running(ordered.running(df, F.col("v"), "s", "file", "i"), F.col("m"), "top", "file", "i", "max").collect()
    for r in got:
        before = [x for x in rows if x[0] == r.file and x[1] <= r.i]
        assert r.s == sum(x[2] for x in before) and r.top == max((x[3] for x in before if x[3] is not None), default=None)
    near = ordered.with_neighbours(ordered.numbered(df, "n", "file", "i"), "n", 1, 2, size=4)
    assert near.where("_home").count() == len(rows) and near.count() > len(rows)


def test_nfkc_of_the_basic_plane(spark):
    texts = [chr(c) for c in (*range(1, 0x3000, 7), *range(0x3000, 0x3400), *range(0xF900, 0x10000, 3))] + ["ｶﾞｷﾞｸﾟ１", "ậ", "が", "㈱ﾊﾟ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.nfkc(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows if r.n != unicodedata.normalize("NFKC", r.t)] == []


def test_crossings_equal_the_plain_test(spark):
    rng = random.Random(8)
    polygon = [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(60)]
    pixels = spark.range(30 * 30).selectExpr("cast(id div 30 as int) as row", "cast(id % 30 as int) as col")
    got = {(r.row, r.col) for r in raster.inside_polygon(spark, pixels, polygon, 20.0, -20 / 29, 0.0, 20 / 29, 29).collect()}
    for row in range(30):
        for col in range(30):
            x, y = 20 / 29 * col, 20.0 + row * (-20 / 29)
            odd = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True)) % 2
            assert ((row, col) in got) == bool(odd)


def test_components_of_a_long_chain(spark):
    rows = spark.createDataFrame([(i, i + 1) for i in range(500)], "src long, dst long")
    assert [r.component for r in components(rows).select("component").distinct().collect()] == [0]


def test_drawing_from_entities(spark):
    rows = [("CIRCLE", 0.0, 0.0, None, None, 0.25, None), ("CIRCLE", 10.0, 0.0, None, None, 0.25, None), ("CIRCLE", 10.0, 0.0001, None, None, 0.25, None), ("MTEXT", 0.4, 0.3, None, None, None, "1.1"), ("MTEXT", 10.4, 0.3, None, None, None, "{\\fX;-1.2}"), ("LWPOLYLINE", 0.1, 0.0, 9.9, 0.0, None, None), ("MTEXT", 5.0, 5.0, None, None, None, "12-3"), ("MTEXT", 5.5, 5.0, None, None, None, "山林"), ("MTEXT", 7.0, 7.0, None, None, None, "水-1")]
    ents = spark.createDataFrame([(1, i, e, "0", *r) for i, (e, *r) in enumerate(rows)], "drawing_id int, ord long, etype string, layer string, x1 double, y1 double, x2 double, y2 double, radius double, text string").withColumn("n_points", F.when(F.col("etype") == "LWPOLYLINE", 2))
    got = drawing.parse_entities(ents)
    assert sorted((r.stake_id, r.number) for r in got.stakes.collect()) == [(0, "1.1"), (1, "-1.2")]
    assert [tuple(r) for r in got.edges.collect()] == [(1, "-1.2", "1.1")]
    assert [(r.number, r.land_use, r.owner) for r in got.parcels.collect()] == [("12-3", "山林", None)]
    assert [r.label for r in got.public_labels.collect()] == ["水-1"]


def test_merge_of_files_read_as_one(spark, monkeypatch):
    """Blank completions, numbers that come again and files that go on in the next one, over chunks of a few lines."""
    monkeypatch.setattr(ordered, "CHUNK", 7)
    rng = random.Random(12)
    for across in (True, False):
        rows, files = [], []
        for file in range(40):
            lines = []
            for i in range(rng.randint(1, 16)):
                entry = rng.choice(["n", "続", "続更新", "続表題", "続表題"])
                parcel = rng.choice(["", "", "1番", "2番"]) if entry in ("続表題", "n") else ""
                lines.append((i, i // 4, str(rng.randint(1, 3)) if entry == "n" else entry, parcel, rng.choice(["", "10", "20"]) if entry != "続" else "", rng.choice("ABC")))
            files.append(lines)
            rows += [(file, *x) for x in lines]
        if across:
            want = model_merge([(file * 100 + x[0], *x[1:]) for file, lines in enumerate(files) for x in lines])
        else:
            want = [(file * 100 + r[0], *r[1:]) for file, lines in enumerate(files) for r in model_merge(lines)]
        df = spark.createDataFrame(rows, "file_no int, line_idx long, page int, entry string, parcel_no string, area string, owner_name string")
        got = [(r.file_no * 100 + r.line_idx, r.page, r.entry, r.parcel_no, r.area, r.owner_name) for r in sequence.merge_lines(df, across=across).orderBy("file_no", "line_idx").collect()]
        assert got == want


def test_registry_rows_of_removed_owners_and_files(spark):
    owner = lambda n: {"address": "A", "share": "", "name": n, "registration": "", "reference": ""}
    schema = "file string, number string, kind string, status string, location string, parcel_no string, real_estate_no string, city_code string, land_use string, area string, history array<string>, owners array<struct<address:string,share:string,name:string,registration:string,reference:string>>, line_idx long"
    row = lambda file, place, names, parcel="1番1": (file, "1", "k", "s", place, parcel, "", "", "田", "1", ["h"], [owner(n) for n in names], 0)
    old = diff.tracked(spark.createDataFrame([row("a", "北 市", ["甲", "乙"]), row("a", "南", ["x"], "2番")], schema))
    new = diff.tracked(spark.createDataFrame([row("b", "北市", ["乙", "丙"])], schema))
    got = [(r.kind, r.item, r.location, r.old_file, r.new_file) for r in diff.registry_diff(old, new, files=True).orderBy("key", "item_ord").collect()]
    assert sorted(got) == sorted([("追加", "所有者", "北市", "a", "b"), ("削除", "所有者", "北 市", "a", "b"), ("削除", "物件", "南", "a", "")])
    three = spark.createDataFrame([row("a", "北", ["甲"]), row("b", "北", ["甲", "乙"]), row("c", "北", ["甲"]), row("c", "南", [], "2番")], schema)
    pairs = {(r.old_file, r.new_file): (r.n_old, r.n_new, r.n_diffs, r.added, r.deleted, r.changed) for r in diff.registry_diff_all_pairs(three).collect()}
    assert pairs == {("a", "b"): (1, 1, 1, 1, 0, 0), ("a", "c"): (1, 2, 1, 1, 0, 0), ("b", "c"): (1, 2, 2, 1, 1, 0)}


def test_rows_of_long_pages():
    rng = random.Random(2)
    for _ in range(200):
        tops = sorted(rng.choice([rng.uniform(0, 60), rng.randint(0, 6) * 7.5]) for _ in range(rng.randint(0, 12)))
        want, first, row = [], None, -1
        for y in tops:
            if first is None or y - first > 15.0:
                first, row = y, row + 1
            want.append(row)
        assert boxes.row_numbers(np.array(tops), 15.0).tolist() == want
    assert boxes.row_numbers(np.array([np.nan, np.nan, 1.0, 5.0]), 15.0).tolist() == [0, 1, 2, 2]
    assert boxes.row_numbers(np.arange(200_000) * 16.0, 15.0)[-1] == 199_999


def test_last_of_repeated_owners_and_one_sided_columns(spark):
    source = spark.createDataFrame([("k", 0, "甲", "B"), ("k", 1, "甲", "A"), ("k", 2, "乙", "C")], "key string, ord int, name string, address string")
    read = spark.createDataFrame([("k", 0, "乙", "")], "key string, ord int, name string, address string")
    assert [(r.kind, r.source_name, r.source_address) for r in reconcile.match_owners(source, read).collect()] == [("消失", "甲", "A")]
    a, b = spark.createDataFrame([(1, "x", 2)], "id int, v string, w int"), spark.createDataFrame([(1, "x", 2)], "id int, v string, z int")
    rows, _ = diff.snapshot_diff({"t": a}, {"t": b})
    assert sorted(tuple(r) for r in rows.collect()) == [("t", "", "column_only_a", "w", ""), ("t", "", "column_only_b", "z", "")]


def test_release_deletes_written_tables(spark):
    table = materialise(spark.range(3).toDF("id"))
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and release(spark) >= 1 and not os.path.isdir(path) and release(spark) == 0


def test_natural_order_sorts_by_columns_not_by_expressions(spark):
    rows = spark.createDataFrame([(1, "10-2"), (2, "9"), (3, "山"), (4, "10番の1")], "id long, number string")
    out = layout.in_parcel_order(rows, F.col("number"), "id")
    assert [r.id for r in out.collect()] == [2, 4, 1, 3]
    sort = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in line)
    assert "rlike" not in sort.lower() and "regexp" not in sort.lower()


def test_blocks_of_a_ring_are_read_once(spark):
    rings = spark.createDataFrame([(1, "P", ["1.1", "2.1", "2.2", "x"])], "ring_id long, parcel_number string, ring array<string>")
    out = layout.ring_layout(rings)
    assert {r.value for r in out.collect() if (r.row, r.col) == (3, 0)} == {"2"}
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("array_position" in line and "regexp" in line for line in lines)


def test_properties_over_chunks_are_whole_and_lines_dealt_once(spark):
    chunk = ordered.CHUNK
    line = lambda at, kind, *cells: ("f", at, ["", kind, *cells])
    lines = [line(1, "表示履歴", "9番", "", "池"), ("f", 5, ["1", "物件情報", "", "", "北", "1番"]), line(6, "所有者", "甲"), ("f", chunk - 1, ["2", "物件情報", "", "", "北", "2番"]), line(chunk + 1, "所有者", "乙"), line(2 * chunk + 3, "表示履歴", "", "", "【田】"), line(2 * chunk + 4, "表示履歴", "", "", "畑"), line(5 * chunk, "所有者", "丙"), ("f", 5 * chunk + 1, ["3", "物件情報", "", "", "北", "3番"])]
    out = diff.rollup_records(spark.createDataFrame(lines, "file string, line_idx long, fields array<string>"))
    got = {r.number: (r.parcel_no, r.land_use, list(r.old_land_uses), [o["name"] for o in r.owners], r.line_idx) for r in out.collect()}
    assert got == {"1": ("1番", "", [], ["甲"], 5), "2": ("2番", "畑", ["田"], ["乙", "丙"], chunk - 1), "3": ("3番", "", [], [], 5 * chunk + 1)}
    # whole properties come as they were written, without another shuffle of what they hold
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") - plan.count("_whole") <= 2 and "_whole" in plan


def test_tracked_sorts_once(spark):
    schema = "file string, line_idx long, number string, location string, parcel_no string"
    rows = [("f", 1, "7", "北", "1番"), ("f", 2, "8", "北", "1番"), ("f", 3, "7", "北", "1番"), ("f", 4, "8", "北", "1番"), ("f", 5, None, "北", "1番"), ("g", 1, "8", "北", "1番")]
    out = diff.tracked(spark.createDataFrame(rows, schema))
    assert sorted((r.file, r.line_idx, r.key) for r in out.collect() if r.key) == [("f", 1, "北|1"), ("f", 3, "北|1|#7"), ("f", 4, "北|1|#8"), ("g", 1, "北|1")]
    assert [r.line_idx for r in out.collect() if r.key is None] == [5]
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [") == 1


def test_shuffles_start_with_many_parts(spark):
    many_parts(spark)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1024 and spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


@pytest.mark.parametrize("value", ["【田】", " a", "a ", "a  b", "a\n", "a\u0085", "<00003042>", "a\tb", "１", "a ", "", None, "が", "北 市", "　"])
def test_plain_texts_are_passed_by_and_others_are_not(spark, value):
    full = lambda c: tx.collapse(tx.decode_codes(tx.nfkc(c)))
    want = one(spark, value, full)
    assert one(spark, value, tx.normalize) == want and one(spark, value, lambda c: tx.normalize_all(F.array(F.lit("所在"), c, F.lit("x")))) == ["所在", want, "x"]


def test_rollup_groups_written_values(spark, monkeypatch):
    """What a line gives is worked out before lines are put together, not node by node inside the lists of a group."""
    plans = []
    monkeypatch.setattr(diff, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    for dialect in ("registry", "source"):
        lines = [("x", 1, ["1", "物件情報", "土地", "", "甲", "3番4", "", "", "", "", ""]), ("x", 2, ["", "表示履歴", "", "", "【田】", "10", "登記"]), ("x", 3, ["", "表示履歴", "", "", "畑", "20", ""]), ("x", 4, ["", "所有者", "乙"]), ("x", 5, ["", "所有権", "丙市", "", "丁"])]
        got = diff.rollup_records(spark.createDataFrame(lines, "file string, line_idx long, fields array<string>"), dialect=dialect).first()
        assert (got.land_use, got.area, got.old_land_uses, [o.name for o in got.owners], len(got.history)) == ("畑", "20", ["田"], ["乙", "丁"], 2)
    grouped = [line for p in plans for line in p.splitlines() if "Aggregate [_chunk" in line]
    assert len(grouped) == 2 and not any("RLIKE" in g or "CASE WHEN" in g or "StartsWith" in g for g in grouped)


def test_merge_lines_works_out_each_row_once(spark, monkeypatch):
    """No written table, nor the result, stands on more than a few running values: each one more would double the work below."""
    plans, write = [], sequence.materialise
    monkeypatch.setattr(sequence, "materialise", lambda df: plans.append(df) or write(df))
    lines = [("f", i, 1, e, p, a, "甲") for i, (e, p, a) in enumerate([("1", "", "5"), ("続表題", "3番", ""), ("続", "", ""), ("2", "4番", "6"), ("続更新", "", "7")])]
    out = sequence.merge_lines(spark.createDataFrame(lines, "file_no string, line_idx long, page int, entry string, parcel_no string, area string, owner_name string"))
    assert [(r.entry, r.parcel_no, r.area) for r in out.orderBy("line_idx").collect()] == [("1", "3番", "5"), ("1", "3番", "5"), ("1", "3番", "5"), ("2", "4番", "6")]
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in [*plans, out]]
    assert max(joins) <= 6, joins


def test_attached_texts_are_found_by_least_distance(spark):
    """Of many near texts the nearest, ties to the lower ord; only pairs at the least distance are put in order."""
    parcels = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0), (3, 900.0, 0.0)], "label_id long, x double, y double")
    texts = spark.createDataFrame([(k, 0.0, 3.0 + k % 5, f"t{k}") for k in range(40)] + [(99, 50.0, 1.0, "u")], "ord long, x double, y double, value string")
    out = drawing.attach(parcels, texts, "land_use", 60.0)
    assert {r.label_id: r.land_use for r in out.collect()} == {1: "t0", 2: "u", 3: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(d" in plan and "_least" in plan



def test_parts_of_the_registry_joins_grow_with_the_files(spark, monkeypatch, tmp_path):
    """A part's memory stays the same with larger inputs, whatever number of parts the session has; the session's own setting stays."""
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for n in names:
        spark.conf.unset(n)
    before = [spark.conf.get(n, None) for n in names]
    lines = [("x", 2 * k + j, f) for k in range(40) for j, f in enumerate((["1", "物件情報", "土地", "", "甲", f"{k}番4"], ["", "所有者", f"乙{k}"]))]
    spark.createDataFrame(lines, "file string, line_idx long, fields array<string>").write.parquet(f"{tmp_path}/lines")
    read = lambda: diff.rollup_records(spark.read.parquet(f"{tmp_path}/lines"))
    monkeypatch.setattr(graph, "FILE_PART", 512)
    old, new = diff.tracked(read()), diff.tracked(read().withColumn("area", F.lit("7")))
    out, parts = diff.registry_diff(old, new), graph.parts_for(old, new)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 40 and parts > 4 and plan.count(f", {parts}), REPARTITION_BY_NUM") == 2
    both = reconcile.reconcile(diff.by_parcel(read()), diff.by_parcel(read()).withColumn("page", F.lit("1")))
    assert both.where("status = 'both'").count() == 40 and "REPARTITION_BY_NUM" in both._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(n, None) for n in names] == before
