"""Hierarchy against an object-by-object evaluation of the rules, joins against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planarlake.functions import grid as G
from planarlake.functions import point as P
from planarlake.functions import ring as R
from planarlake.operators import boxes, catalog, equality, filters, hierarchy, spatial

SF = "/root/testdata/sf0.001"


def rot(p, a, c=(0, 0)):
    r = math.radians(a)
    x, y = p[0] - c[0], p[1] - c[1]
    return c[0] + x * math.cos(r) - y * math.sin(r), c[1] + x * math.sin(r) + y * math.cos(r)


def copies(e, g):
    """Copies of an element under a grid, one after another, by mirroring, turning, scaling and moving."""
    for col in range(g["columns"]):
        for row in range(g["rows"]):
            o, sx, sy = g["origin"], g["spacing_x"], g["spacing_y"]
            at = rot((o[0] + sx[0] * col + sy[0] * row, o[1] + sx[1] * col + sy[1] * row), g["angle"], o)
            n = dict(e)
            m = -1 if g["x_reflection"] else 1
            move = lambda p, m=m, at=at: (lambda q: (q[0] * g["magnification"] + at[0], q[1] * g["magnification"] + at[1]))(rot((p[0], p[1] * m), g["angle"]))
            if e["kind"] == "polygon":
                n["points"] = [move(p) for p in e["points"]]
            elif e["kind"] == "text":
                n["origin"] = move(e["origin"])
                n["angle"] = (-e["angle"] if m < 0 else e["angle"]) + g["angle"]
                n["magnification"] = e["magnification"] * g["magnification"]
            else:
                h = dict(e["grid"])
                o2 = rot(h["origin"], g["angle"])
                h["origin"] = (o2[0] * g["magnification"] + at[0], o2[1] * g["magnification"] + at[1])
                for k in ("spacing_x", "spacing_y"):
                    h[k] = tuple(v * g["magnification"] for v in h[k])
                h["angle"] = (h["angle"] + g["angle"]) % 360
                h["magnification"] *= g["magnification"]
                h["x_reflection"] ^= g["x_reflection"]
                n["grid"] = h
            yield n


def on(e, pairs, cells):
    if not pairs:
        return True
    if e["kind"] == "polygon":
        return (e["layer"], e["data_type"]) in pairs
    if e["kind"] == "text":
        return e["layer"] in {p for p, _ in pairs}
    return all(on(x, pairs, cells) for x in cells[e["target"]])


def flat(ref, pairs, depth, cells):
    if depth == 0:
        return [ref]
    out = []
    for e in cells[ref["target"]]:
        inner = [e] if e["kind"] != "reference" else flat(e, pairs, depth - 1, cells)
        out += [y for x in inner if on(x, pairs, cells) for y in copies(x, ref["grid"])]
    return out


def case(seed):
    rnd = random.Random(seed)
    names = ["top", "a", "b", "c", "leaf"]
    cells = {n: [] for n in names}
    k = 0
    for i, n in enumerate(names):
        for _ in range(rnd.randint(0, 2) if n != "leaf" else 2):
            k += 1
            cells[n].append({"kind": "polygon", "id": k, "layer": rnd.randrange(3), "data_type": rnd.randrange(2), "points": [(rnd.randint(-9, 9), rnd.randint(-9, 9)) for _ in range(4)]})
        for _ in range(rnd.randint(0, 1)):
            k += 1
            cells[n].append({"kind": "text", "id": k, "layer": rnd.randrange(3), "origin": (rnd.randint(-9, 9), 2.5), "angle": float(rnd.choice([0, 45, 270])), "magnification": 2.0})
        for _ in range(2 if i < 4 else 0):
            k += 1
            g = {"origin": (rnd.randint(-50, 50), rnd.randint(-50, 50)), "columns": rnd.randint(1, 2), "rows": rnd.randint(1, 2), "spacing_x": (rnd.randint(0, 9), 1), "spacing_y": (0, rnd.randint(0, 9)), "magnification": float(rnd.randint(1, 2)), "angle": float(rnd.choice([0, 45, 90, 180, 359])), "x_reflection": rnd.random() < 0.5}
            cells[n].append({"kind": "reference", "id": k, "target": rnd.choice(names[i + 1 :]), "grid": g})
    return cells


def tables(spark, cells):
    every = [(n, e) for n, es in cells.items() for e in es]
    grid = lambda g: ((float(g["origin"][0]), float(g["origin"][1])), g["columns"], g["rows"], tuple(map(float, g["spacing_x"])), tuple(map(float, g["spacing_y"])), g["magnification"], g["angle"], g["x_reflection"])
    xy = "struct<x:double,y:double>"
    refs = spark.createDataFrame(
        [(n, e["id"], "cell", e["target"], None, grid(e["grid"])) for n, e in every if e["kind"] == "reference"],
        f"cell_name string, elem_id long, target_kind string, target_cell string, target_elem_id long, grid struct<origin:{xy},columns:long,rows:long,spacing_x:{xy},spacing_y:{xy},magnification:double,angle:double,x_reflection:boolean>",
    )
    fl = lambda p: (float(p[0]), float(p[1]))
    polys = spark.createDataFrame([(n, e["id"], e["layer"], e["data_type"], [fl(p) for p in e["points"]]) for n, e in every if e["kind"] == "polygon"], f"cell_name string, elem_id long, layer int, data_type int, points array<{xy}>")
    paths = spark.createDataFrame([], f"cell_name string, elem_id long, layer int, data_type int, points array<{xy}>")
    texts = spark.createDataFrame([(n, e["id"], e["layer"], "t", fl(e["origin"]), e["magnification"], e["angle"]) for n, e in every if e["kind"] == "text"], f"cell_name string, elem_id long, layer int, text string, origin {xy}, magnification double, angle double")
    return refs, polys, paths, texts


r5 = lambda v: round(v, 5) + 0.0


def test_flatten_equals_object_by_object(spark):
    cells = case(1)
    t = tables(spark, cells)
    root = spark.createDataFrame([("top",)], "root string")
    for pairs, depth in (([], None), ([], 0), ([], 2), ([(0, 1), (2, 0)], 1), ([(0, 1), (2, 0)], 2), ([(0, 1), (2, 0)], None)):
        if depth == 0:
            want = list(cells["top"])
        else:
            want = [e for e in cells["top"] if e["kind"] != "reference"] + [x for e in cells["top"] if e["kind"] == "reference" for x in flat(e, pairs, 99 if depth is None else depth, cells)]
        got = hierarchy.flatten(root, *t, pairs=pairs, depth=depth)
        p = sorted((e["id"], [(r5(x), r5(y)) for x, y in e["points"]]) for e in want if e["kind"] == "polygon")
        assert sorted((r.elem_id, [(r5(v.x), r5(v.y)) for v in r.points]) for r in got["polygons"].collect()) == p
        x = sorted((e["id"], r5(e["origin"][0]), r5(e["origin"][1]), r5(e["angle"] % 360), e["magnification"]) for e in want if e["kind"] == "text")
        assert sorted((r.elem_id, r5(r.origin.x), r5(r.origin.y), r5(r.angle % 360), r.magnification) for r in got["texts"].collect()) == x
        rs = sorted((e["id"], r5(e["grid"]["origin"][0]), r5(e["grid"]["origin"][1]), r5(e["grid"]["angle"] % 360), e["grid"]["magnification"], e["grid"]["x_reflection"], r5(e["grid"]["spacing_x"][0])) for e in want if e["kind"] == "reference")
        mine = got["references"].collect() if depth is not None else []
        assert sorted((r.elem_id, r5(r.grid.origin.x), r5(r.grid.origin.y), r5(r.grid.angle % 360), r.grid.magnification, r.grid.x_reflection, r5(r.grid.spacing_x.x)) for r in mine) == rs


def test_cycles_fail(spark):
    cells = {"top": [], "a": []}
    g = {"origin": (0, 0), "columns": 1, "rows": 1, "spacing_x": (0, 0), "spacing_y": (0, 0), "magnification": 1.0, "angle": 0.0, "x_reflection": False}
    for i, (n, to) in enumerate((("top", "a"), ("a", "top"))):
        cells[n].append({"kind": "reference", "id": i, "target": to, "grid": g})
    refs = tables(spark, cells)[0]
    with pytest.raises(ValueError, match="refers to itself"):
        hierarchy.placements(spark.createDataFrame([("top",)], "root string"), refs).collect()
    with pytest.raises(ValueError, match="refers to itself"):
        hierarchy.reachable(refs, spark.createDataFrame([("top",)], "cell_name string"))


GRID = {"origin": (1, 0), "columns": 1, "rows": 1, "spacing_x": (0, 0), "spacing_y": (0, 0), "magnification": 1.0, "angle": 0.0, "x_reflection": False}


def test_long_chains_and_shared_cells(spark, monkeypatch):
    deep = {f"c{i}": [{"kind": "reference", "id": i, "target": f"c{i + 1}", "grid": GRID}] for i in range(100)} | {"c100": []}
    refs = tables(spark, deep)[0]
    names = spark.createDataFrame([(n,) for n in deep], "cell_name string")
    assert hierarchy.reachable(refs, names).groupBy("cell_name").count().where("cell_name in ('c0', 'c50')").orderBy("cell_name").collect() == [("c0", 101), ("c50", 51)]
    placed = hierarchy.placements(spark.createDataFrame([("c0",)], "root string"), refs).select("cell_name", "depth", "tx").collect()
    assert len(placed) == 101 and {(r.cell_name, r.tx) for r in placed} == {(f"c{i}", float(i)) for i in range(101)}
    root = spark.createDataFrame([("c0",), ("c7",)], "root string")
    assert hierarchy.deepest(refs, root) == 100 and hierarchy.deepest(refs, root.where("root = 'c7'")) == 93 and hierarchy.deepest(refs.limit(0), root) == 0
    monkeypatch.setattr(hierarchy, "WALKED", 5)
    assert hierarchy.deepest(refs, root) == 100
    # A depth beyond the deepest cell adds nothing.
    assert hierarchy.placements(spark.createDataFrame([("c95",)], "root string"), refs, 1000).count() == 6
    shared = {}
    for i in range(30):
        shared[f"t{i}"] = [{"kind": "reference", "id": 10 * i + k, "target": f"{side}{i}", "grid": GRID} for k, side in enumerate("lr")]
        for k, side in enumerate("lr"):
            shared[f"{side}{i}"] = [{"kind": "reference", "id": 10 * i + 5 + k, "target": f"t{i + 1}", "grid": GRID}]
    reach = hierarchy.reachable(tables(spark, shared)[0], spark.createDataFrame([("t0",), ("t29",)], "cell_name string"))
    assert sorted(reach.groupBy("cell_name").count().collect()) == [("t0", 91), ("t29", 4)]


def test_references_to_references(spark):
    """top has A, whose target is B, whose target is C (both of no cell), which places the cell low."""
    rnd = random.Random(8)
    grids = [GRID | {"origin": (rnd.randint(-9, 9), rnd.randint(-9, 9)), "columns": 2, "spacing_x": (rnd.randint(1, 5), 1), "angle": a, "magnification": m, "x_reflection": x} for a, m, x in ((90.0, 2.0, True), (45.0, 1.0, False), (270.0, 3.0, True))]
    low = [{"kind": "polygon", "id": 1, "layer": 1, "data_type": 0, "points": [(0, 0), (2, 0), (1, 3)]}, {"kind": "text", "id": 2, "layer": 1, "origin": (1, 1), "angle": 30.0, "magnification": 1.0}]
    refs, *rest = tables(spark, {"low": low, "top": [{"kind": "reference", "id": i, "target": "low", "grid": g} for i, g in zip((10, 11, 12), grids)]})
    nested = refs.withColumn("cell_name", F.when(F.col("elem_id") == 10, "top")).withColumn("target_elem_id", F.when(F.col("elem_id") < 12, F.col("elem_id") + 1))
    nested = nested.withColumn("target_kind", F.when(F.col("elem_id") < 12, "reference").otherwise("cell")).withColumn("target_cell", F.when(F.col("elem_id") == 12, "low"))
    root = spark.createDataFrame([("top",)], "root string")
    want = low
    for g in reversed(grids):
        want = [c for e in want for c in copies(e, g)]
    got = hierarchy.flatten(root, nested, *rest)
    points = lambda es: sorted([(r5(x), r5(y)) for x, y in e] for e in es)
    assert points([(p.x, p.y) for p in r.points] for r in got["polygons"].collect()) == points(e["points"] for e in want if e["kind"] == "polygon")
    texts = lambda es: sorted((r5(x), r5(y), r5(a % 360), m) for x, y, a, m in es)
    assert texts((r.origin.x, r.origin.y, r.angle, r.magnification) for r in got["texts"].collect()) == texts((*e["origin"], e["angle"], e["magnification"]) for e in want if e["kind"] == "text")
    assert hierarchy.flatten(root, nested, *rest, pairs=[(9, 9)])["polygons"].count() == 0
    # Depth 1 leaves B's copies under A, with B's target; depth 0 leaves A.
    one = hierarchy.flatten(root, nested, *rest, depth=1)["references"].collect()
    mid = list(copies({"kind": "reference", "grid": grids[1]}, grids[0]))
    assert {(r.target_kind, r.target_elem_id, r.target_cell) for r in one} == {("reference", 12, None)}
    assert sorted((r5(r.grid.origin.x), r5(r.grid.origin.y), r5(r.grid.angle), r.grid.x_reflection) for r in one) == sorted((r5(e["grid"]["origin"][0]), r5(e["grid"]["origin"][1]), r5(e["grid"]["angle"]), e["grid"]["x_reflection"]) for e in mid)
    zero = hierarchy.flatten(root, nested, *rest, depth=0)["references"].collect()
    assert [(r.elem_id, r.target_kind, r.target_elem_id) for r in zero] == [(10, "reference", 11)]
    names = spark.createDataFrame([("top",), ("low",)], "cell_name string")
    assert sorted(tuple(r) for r in hierarchy.reachable(nested, names).collect()) == [("low", "low"), ("top", "low"), ("top", "top")]


def test_references_to_references_are_written_as_copies(spark, tmp_path):
    from planarlake.sources import gds

    a, b = GRID | {"columns": 2, "spacing_x": (10, 0), "angle": 90.0}, GRID | {"origin": (3, 4), "magnification": 2.0}
    low = [{"kind": "polygon", "id": 1, "layer": 1, "data_type": 0, "points": [(0, 0), (2, 0), (1, 3), (0, 0)]}]
    refs, polygons, paths, texts = tables(spark, {"low": low, "top": [{"kind": "reference", "id": 10, "target": "low", "grid": a}, {"kind": "reference", "id": 11, "target": "low", "grid": b}]})
    nested = refs.withColumn("cell_name", F.when(F.col("elem_id") == 10, "top")).withColumn("target_elem_id", F.when(F.col("elem_id") == 10, F.lit(11).cast("long")))
    nested = nested.withColumn("target_kind", F.when(F.col("elem_id") == 10, "reference").otherwise("cell")).withColumn("target_cell", F.when(F.col("elem_id") == 11, "low"))
    cells = spark.createDataFrame([("top", 0), ("low", 1)], "cell_name string, cell_seq long")
    seq = lambda d: d.withColumn("elem_seq", F.col("elem_id"))
    t = {"cells": cells, "polygons": seq(polygons), "references": seq(nested)}
    for path in (gds.write(t, f"file://{tmp_path}/n.gds"), gds.write_cell(t, "top", f"file://{tmp_path}/m.gds")):
        back = gds.read(spark, path)
        got = sorted((r.cell_name, r.target_cell, r5(r.grid.origin.x), r5(r.grid.origin.y), r.grid.magnification, r.grid.angle) for r in back["references"].collect())
        want = sorted(("top", "low", r5(e["grid"]["origin"][0]), r5(e["grid"]["origin"][1]), 2.0, 90.0) for e in copies({"kind": "reference", "grid": b}, a))
        assert got == want and back["polygons"].count() == 1 and back["cells"].count() == 2


def test_cell_and_element_references_agree(spark):
    g = G.grid((3, 4), 3, 2, (5, 1), (0, 7), 2, 45, True)
    square = R.as_points([(0, 0), (1, 0), (1, 1), (0, 0)])
    one = spark.range(1).select(g.alias("grid"), square.alias("points"))
    a = {tuple((r5(p.x), r5(p.y)) for p in r.points) for r in hierarchy.grid_copies(one, "polygon").collect()}
    refs = spark.range(1).select(F.lit("top").alias("cell_name"), F.lit(1).cast("long").alias("elem_id"), F.lit("polygon").alias("target_kind"), F.lit(None).cast("string").alias("target_cell"), F.lit(7).cast("long").alias("target_elem_id"), g.alias("grid"))
    polys = spark.range(1).select(F.lit(None).cast("string").alias("cell_name"), F.lit(7).cast("long").alias("elem_id"), F.lit(1).alias("layer"), F.lit(0).alias("data_type"), square.alias("points"))
    texts = spark.createDataFrame([], "cell_name string, elem_id long, layer int, text string, origin struct<x:double,y:double>, magnification double, angle double")
    got = hierarchy.flatten(spark.createDataFrame([("top",)], "root string"), refs, polys, polys.limit(0), texts)["polygons"].collect()
    assert len(a) == 6 and {tuple((r5(p.x), r5(p.y)) for p in r.points) for r in got} == a
    off = hierarchy.flatten(spark.createDataFrame([("top",)], "root string"), refs, polys, polys.limit(0), texts, pairs=[(9, 9)])["polygons"]
    assert off.count() == 0


def test_boxes_equal_those_of_what_is_flattened(spark):
    from planarlake.operators import boxes

    for seed in (1, 5):
        cells = case(seed)
        refs, polys, _, texts = tables(spark, cells)
        wide = polys.where("elem_id % 2 = 0").withColumn("path_type", F.lit(0)).withColumn("width", F.lit(1.5)).withColumn("elem_id", F.col("elem_id") + 1000)
        # References to elements and to references as well.
        own = refs.limit(1).withColumn("cell_name", F.lit("top")).withColumn("target_cell", F.lit(None).cast("string"))
        first = lambda t: t.agg(F.min("elem_id")).first()[0]
        for i, (kind, of) in enumerate((("polygon", first(polys)), ("text", first(texts)), ("path", first(wide)), ("reference", first(refs)))):
            refs = refs.union(own.withColumn("elem_id", F.lit(500 + i).cast("long")).withColumn("target_kind", F.lit(kind)).withColumn("target_elem_id", F.lit(of).cast("long")).select(*refs.columns))
        roots = spark.createDataFrame([(n,) for n in cells], "root string")
        flat = hierarchy.flatten(roots, refs, polys, wide, texts)
        want = boxes.cell_boxes(flat["polygons"], flat["paths"], flat["texts"], ["root"])
        got = boxes.union_boxes([hierarchy.drawn_boxes(roots, refs, polys, wide, texts)], ["root"])
        rows = lambda d: sorted((r.root, *[r5(r[k]) for k in boxes.BOX]) for r in d.collect())
        assert rows(got) == rows(want) and len(rows(got)) > 2
        up = hierarchy.cell_boxes(roots.withColumnRenamed("root", "cell_name"), refs, polys, wide, texts).withColumnRenamed("cell_name", "root")
        assert rows(up) == rows(want)


def test_tile_joins_equal_all_pairs(spark):
    rnd = random.Random(3)
    shape = lambda s: (lambda x, y: [(x, y), (x + s, y + s / 3), (x + s / 2, y + s), (x, y)])(rnd.uniform(-99, 99), rnd.uniform(-99, 99))
    rows = [(i, [(float(a), float(b)) for a, b in shape(rnd.choice([1, 5, 20, 400]))]) for i in range(60)]
    polys = spark.createDataFrame(rows, "elem_id long, points array<struct<x:double,y:double>>")
    probes = spark.createDataFrame([(i, rnd.uniform(-120, 120), rnd.uniform(-120, 120)) for i in range(300)], "pt_id long, px double, py double")
    got = sorted(tuple(r) for r in spatial.point_in_polygon(probes, polys, 3.0).select("pt_id", "elem_id").collect())
    want = probes.crossJoin(polys).where(R.contains(F.col("points"), P.point(F.col("px"), F.col("py")))).select("pt_id", "elem_id")
    assert got == sorted(tuple(r) for r in want.collect()) and got
    pairs = spatial.polygon_pairs(polys, polys, 3.0).where("a < b").collect()
    other = polys.select(F.col("elem_id").alias("b"), F.col("points").alias("q"))
    want = polys.crossJoin(other).where((F.col("elem_id") < F.col("b")) & R.intersects(F.col("points"), F.col("q"))).select("elem_id", "b")
    assert sorted(tuple(r) for r in pairs) == sorted(tuple(r) for r in want.collect()) and pairs
    plan = spatial.point_in_polygon(probes, polys, 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_crowded_spots(spark):
    """Nine of ten polygons in one spot, some very large: rows as all pairs give them, and no tile with much in it."""
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        s, w = (0.01, 1.0) if i % 10 else (rnd.choice([3.0, 900.0]), 500.0)
        x, y = rnd.uniform(-w, w), rnd.uniform(-w, w)
        rows.append((i, [(x, y), (x + s, y), (x + s / 2, y + s), (x, y)]))
    rows.append((400, [(5.0, 5.0)] * 4))
    polys = spark.createDataFrame(rows, "elem_id long, points array<struct<x:double,y:double>>")
    probes = spark.createDataFrame([(i, rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(400)] + [(999, 5.0, 5.0)], "pt_id long, px double, py double")
    got = sorted(tuple(r) for r in spatial.point_in_polygon(probes, polys).select("pt_id", "elem_id").collect())
    want = probes.crossJoin(polys).where(R.contains(F.col("points"), P.point(F.col("px"), F.col("py")))).select("pt_id", "elem_id")
    assert got == sorted(tuple(r) for r in want.collect()) and got
    pairs = spatial.polygon_pairs(polys, polys).where("a < b").collect()
    other = polys.select(F.col("elem_id").alias("b"), F.col("points").alias("q"))
    want = polys.crossJoin(other).where((F.col("elem_id") < F.col("b")) & R.intersects(F.col("points"), F.col("q"))).select("elem_id", "b")
    assert sorted(tuple(r) for r in pairs) == sorted(tuple(r) for r in want.collect()) and pairs
    tiles = spatial._tiles(spatial._boxed(polys, None), None)
    assert tiles.groupBy("elem_id").count().agg(F.max("count")).first()[0] <= 4
    assert tiles.where("elem_id % 10 > 0").groupBy("level", "tx", "ty").count().agg(F.max("count")).first()[0] <= 10


def test_counts_without_rows(spark, monkeypatch):
    """Points counted by tile are those of the join row by row, corners and edges too; no row is made for a pair."""
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        s, w = (0.02, 1.0) if i % 3 else (8.0, 30.0)
        x, y = rnd.uniform(0, w), rnd.uniform(0, w)
        p = [(x + rnd.uniform(0, s), y + rnd.uniform(0, s)) for _ in range(rnd.randint(1, 7))] if i % 2 else [(float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for _ in range(5)]
        rows.append((i, p + p[:1]))
    polys = spark.createDataFrame(rows, "elem_id long, points array<struct<x:double,y:double>>")
    spots = [(rnd.uniform(0, 1), rnd.uniform(0, 1)) for _ in range(300)] + [(rnd.randint(0, 18) / 2, rnd.randint(0, 18) / 2) for _ in range(300)] + [v for _, p in rows for v in p] + [(float("nan"), 1.0), (1.0, None)]
    probes = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "pt_id long, px double, py double")
    want = probes.crossJoin(polys).where(R.contains(F.col("points"), P.point(F.col("px"), F.col("py")))).groupBy("elem_id").count()
    want = sorted(tuple(r) for r in want.collect())
    assert sorted(tuple(r) for r in spatial.points_in_polygons(probes, polys, 3.0).collect()) == want and len(want) > 100
    monkeypatch.setattr(spatial, "IN_TILE", 40)
    counted = spatial.points_in_polygons(probes, polys)
    assert sorted(tuple(r) for r in counted.collect()) == want
    assert "FlatMapCoGroupsInArrow" in counted._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_not_shuffled(spark):
    """Pairs of polygons are tested where they meet: the plan has one join, and nothing after it is shuffled."""
    polys = spark.createDataFrame([(i, [(float(i), 0.0), (i + 3.0, 0.0), (i + 3.0, 2.0), (float(i), 0.0)]) for i in range(9)], "elem_id long, points array<struct<x:double,y:double>>")
    pairs = spatial.polygon_pairs(polys, polys, 2.0, distinct=True)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(tuple(r) for r in spatial.polygon_pairs(polys, polys, 2.0).where("a < b").collect())
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_pairs_by_tile(spark, monkeypatch):
    """Pairs tested many at once are those of all pairs tested row by row: corners on edges, open rings, points, many corners,
    coordinates that are no numbers, ids twice, two tables, crowded tiles in parts; no ring is gone through for each pair."""
    rnd = random.Random(6)
    rows = []
    for i in range(90):
        s, w = (0.5, 3.0) if i % 3 else (rnd.choice([6.0, 300.0]), 40.0)
        x, y = rnd.uniform(-w, w), rnd.uniform(-w, w)
        n = 40 if i % 11 == 0 else rnd.randint(1, 6)
        p = [(x + rnd.uniform(0, s), y + rnd.uniform(0, s)) for _ in range(n)] if i % 2 else [(float(rnd.randint(-2, 3)), float(rnd.randint(-2, 3))) for _ in range(n)]
        rows.append((i, p if i % 5 == 0 else p + p[:1]))
    rows += [(7, rows[8][1]), (90, []), (91, [(0.0, 0.0), (float("nan"), 1.0), (2.0, 2.0), (0.0, 0.0)]), (92, [(0.0, 0.0), (None, 1.0), (2.0, 1.0)])]
    rows += [(93, [(0.0, 0.0), (1e200, 0.0), (1e200, 1e200)]), (None, [(0.0, 0.0), (2.0, 0.0), (1.0, 2.0)])]
    polys = spark.createDataFrame(rows, "elem_id long, points array<struct<x:double,y:double>>")
    text = lambda t: sorted(str(tuple(r)) for r in t.collect())

    def want(one, two):
        a, b = (boxes.polygon_boxes(t).select(*[F.col(k).alias(f"{p}_{k}") for k in ("elem_id", "points", *boxes.BOX)]) for p, t in (("a", one), ("b", two)))
        overlap = " and ".join(f"a_min_{k} <= b_max_{k} and b_min_{k} <= a_max_{k}" for k in "xy")
        return a.crossJoin(b).where(overlap).where(R.intersects(F.col("a_points"), F.col("b_points"))).select("a_elem_id", "b_elem_id")

    some = polys.where("elem_id % 4 < 2")
    every, below, two = text(want(polys, polys)), text(want(polys, polys).where("a_elem_id < b_elem_id")), text(want(some, polys))
    for tile, most in ((2.0, spatial.IN_TILE), (None, spatial.IN_TILE), (2.0, 60)):
        monkeypatch.setattr(spatial, "IN_TILE", most)
        assert text(spatial.polygon_pairs(polys, polys, tile, distinct=True)) == below and len(below) > 500
        if tile:
            assert text(spatial.polygon_pairs(polys, polys, tile)) == every
            assert text(spatial.polygon_pairs(some, polys, tile)) == two
    finite = spatial.polygon_pairs(polys.limit(80), polys.limit(80), 2.0)
    plan = finite._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "exists(" not in plan


def test_large_rings(spark, monkeypatch):
    """Tested over slabs, rings contain what they contain as a whole: zigzags, level edges, corners, no height."""
    rnd = random.Random(5)
    zigzag = [(float(i), 50.0 * (i % 2) + i % 3) for i in range(40)] + [(40.0, -7.0), (0.0, -7.0), (0.0, 0.0)]
    star = [(rnd.uniform(0, 40), float(rnd.randint(0, 40))) for _ in range(60)]
    rows = [(1, zigzag), (2, star + star[:1]), (3, [(float(i), 3.0) for i in range(30)]), (4, [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 0.0)])]
    polys = spark.createDataFrame(rows, "elem_id long, points array<struct<x:double,y:double>>")
    spots = [(rnd.uniform(-1, 41), rnd.uniform(-8, 53)) for _ in range(300)] + zigzag + star + [(5.5, 3.0), (float(3), float(7))] * 2
    probes = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "pt_id long, px double, py double")
    whole = sorted((r.pt_id, r.elem_id, len(r.points)) for r in spatial.point_in_polygon(probes, polys, 8.0).collect())
    monkeypatch.setattr(spatial, "LARGE", 10)
    assert sorted((r.pt_id, r.elem_id, len(r.points)) for r in spatial.point_in_polygon(probes, polys, 8.0).collect()) == whole
    assert {e for _, e, _ in whole} == {1, 2, 3, 4}


def test_tiny_magnifications_have_boxes(spark):
    """Cells drawn very small keep their size."""
    row = lambda *v: spark.createDataFrame([v], "cell_name string, elem_id long, layer int, data_type int, points array<struct<x:double,y:double>>")
    polys = row("low", 1, 0, 0, [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 0.0)])
    one = spark.range(1)
    refs = one.select(F.lit("top").alias("cell_name"), F.lit(2).cast("long").alias("elem_id"), F.lit("cell").alias("target_kind"), F.lit("low").alias("target_cell"), F.lit(None).cast("long").alias("target_elem_id"), G.grid((0, 0), 1, 1, (0, 0), (0, 0), 1e-13).alias("grid"))
    paths = spark.createDataFrame([], "cell_name string, elem_id long, layer int, data_type int, path_type int, width double, points array<struct<x:double,y:double>>")
    texts = spark.createDataFrame([], "cell_name string, elem_id long, layer int, text string, origin struct<x:double,y:double>, magnification double, angle double, x_reflection boolean, vertical_presentation int, horizontal_presentation int")
    box = hierarchy.drawn_boxes(spark.createDataFrame([("top",)], "root string"), refs, polys, paths, texts).where("cell_name = 'low'").first()
    assert math.isclose(box.max_x, 3e-13, rel_tol=1e-9) and math.isclose(box.max_y, 3e-13, rel_tol=1e-9)


def test_catalog(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_name string")
    with pytest.raises(ValueError):
        catalog.add_cells(cells, cells)
    assert catalog.add_cells(cells, cells, replace=True).count() == 2
    assert [r.cell_name for r in catalog.remove_cells(cells, spark.createDataFrame([("a",), ("zz",)], "cell_name string")).collect()] == ["b"]
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    kind = "cell_name string, elem_id long, layer int, data_type int, points array<struct<x:double,y:double>>"
    mine = spark.createDataFrame([("a", 1, 0, 0, square), ("a", 2, 1, 0, square)], kind)
    near = spark.createDataFrame([("a", 9, 0, 0, [(x + 0.00005, y - 0.00005) for x, y in square])], kind)
    far = spark.createDataFrame([("a", 9, 0, 0, [(x + 0.001, y) for x, y in square])], kind)
    keys = ["cell_name", "layer", "data_type"]
    assert catalog.contains_elements(mine, near, keys).count() == 1 and catalog.contains_elements(mine, far, keys).count() == 0
    assert [r.elem_id for r in catalog.remove_elements(mine, near, keys).collect()] == [2]
    assert filters.is_on(mine, [(1, 0)]).count() == 1 and filters.is_on(mine, []).count() == 2
    assert equality.unequal_elements(mine, mine, "polygons").count() == 0
    assert [tuple(r) for r in equality.unequal_elements(mine, near, "polygons").collect()] == [("a", 2)]


def test_large_arrays_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "TASK_COPIES", 50)
    one = spark.range(1).select(G.grid((0, 0), 20, 30, (2, 0), (0, 2)).alias("grid"), R.as_points([(0, 0), (1, 0), (1, 1), (0, 0)]).alias("points"))
    got = hierarchy.grid_copies(one, "polygon")
    assert got.rdd.getNumPartitions() == 13 and got.select(F.element_at("points", 1)["x"].alias("x"), F.element_at("points", 1)["y"].alias("y")).distinct().count() == 600
