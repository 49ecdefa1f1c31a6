import pytest
from pyspark.sql import functions as F

from planarlake import library as L
from planarlake.functions import grid as G

lit = F.lit


def make(spark):
    one = spark.range(1)
    key = lambda cell, i: [lit(cell).alias("cell_name"), lit(i).cast("long").alias("elem_id"), lit(i).cast("long").alias("elem_seq")]
    cells = spark.createDataFrame([("top", 0), ("low", 1), ("none", 2)], "cell_name string, cell_seq long")
    grid = G.grid((10, 0), 5, 5, (2, 0), (0, 2))
    return L.Library.empty(spark, "lib").add(cells).add_elements(
        polygons=one.select(*key("low", 1), *L.polygon([(0, 0), (1, 0), (1, 1), (0, 1)], 3, 1)),
        paths=one.select(*key("top", 2), *L.path([(0, 0), (0, 1)], 1, 0, 1, 0.5)),
        texts=one.select(*key("low", 3), *L.text("ab", (1, 1), 3)),
        references=one.select(*key("top", 4), lit("cell").alias("target_kind"), lit("low").alias("target_cell"), grid.alias("grid")),
    )


def test_library(spark, tmp_path):
    lib = make(spark)
    assert str(lib) == "Library 'lib' with 3 cells" and repr(lib) == "Library(lib)"
    flat = lib.flatten()
    assert flat.polygons.where("cell_name = 'top'").count() == 25 and flat.polygons.where("cell_name = 'low'").count() == 1 and flat.references.count() == 0
    assert lib.flatten((9, 9)).polygons.where("cell_name = 'top'").count() == 0
    assert lib.flatten(depth=0) is lib
    only = lib.elements("top", (3, 1))
    assert only.polygons.count() == 25 and only.paths.count() == 0 and only.texts.count() == 25
    box = {r.cell_name: tuple(r)[1:] for r in lib.bounding_boxes().collect()}
    assert box["low"] == (0, 0, 2, 1.5) and box["top"] == (-0.25, -0.25, 20, 9.5) and "none" not in box
    assert {r.cell_name: r.is_on for r in lib.is_on([(3, 1)]).collect()} == {"top": False, "low": True, "none": True}
    assert [r.cell_name for r in lib.empty_cells().collect()] == ["none"]
    assert {r.cell_name: (r.n_polygons, r.n_paths, r.n_references, r.n_texts) for r in lib.counts().collect()}["top"] == (0, 1, 1, 0)
    moved = lib.move_by((1, 2)).scale(2).rotate(90)
    assert abs(moved.polygons.first().points[0].y - 2) < 1e-9 and moved.references.first().grid.angle == 90
    assert lib.move_to((7, 7)).texts.first().origin.x == 7
    assert lib.equals(lib) and not lib.equals(moved)
    gone = lib.remove(spark.createDataFrame([("low",)], "cell_name string"))
    assert gone.cells.count() == 2 and gone.polygons.count() == 0
    with pytest.raises(ValueError):
        lib.add(lib.cells)
    assert (lib + lib.cells.where("cell_name = 'low'")).polygons.count() == 0
    back = L.Library.from_gds(spark, lib.to_gds(f"file://{tmp_path}/x.gds"))
    assert back.cells.count() == 3 and back.flatten().polygons.where("cell_name = 'top'").count() == 25


def test_equality_and_membership(spark):
    from dataclasses import replace

    lib = make(spark)
    shift = lambda v, **k: replace(lib, polygons=lib.polygons.withColumn("points", L.R.move_by(L.c("points"), (v, 0))), **k)
    assert lib.equals(shift(0.00005)) and not lib.equals(shift(0.001)) and not lib.equals(shift(0.0, name="other"))
    assert sorted(r.cell_name for r in lib.contains(shift(0.001)).collect()) == ["none"]  # the top cell places what has moved
    assert sorted(r.cell_name for r in lib.contains(shift(0.001), epsilon=0.01).collect()) == ["low", "none", "top"] and lib.equals(shift(0.001), epsilon=0.01)
    assert sorted(r.cell_name for r in lib.contains(replace(lib, texts=lib.texts.limit(0), references=lib.references.withColumn("grid", G.move_by(L.c("grid"), (1, 0))))).collect()) == ["none"]
    # Places count, not the numbers that order them.
    assert lib.equals(replace(lib, paths=lib.paths.withColumn("elem_seq", L.c("elem_seq") + 70)))
    assert lib.named(spark.createDataFrame([("low",), ("zz",)], "cell_name string")).count() == 1
    near = (0.00004, -0.00004)
    close = {
        "polygons": lib.polygons.withColumn("points", L.R.move_by(L.c("points"), near)), "paths": lib.paths.withColumn("points", L.R.move_by(L.c("points"), near)),
        "texts": lib.texts.withColumn("origin", L.P.add(L.c("origin"), L.P.point(*near))), "references": lib.references.withColumn("grid", G.move_by(L.c("grid"), near)),
    }
    assert all(v.count() == 1 for v in lib.contains_elements(**close).values())
    gone = lib.remove_elements(**close)
    assert all(getattr(gone, k).count() == 0 for k in L.TABLES)
    other = {"texts": close["texts"].withColumn("layer", lit(9)), "paths": close["paths"].withColumn("width", lit(0.75)), "references": close["references"].withColumn("target_cell", lit("none")), "polygons": close["polygons"].withColumn("cell_name", lit("top"))}
    assert all(v.count() == 0 for v in lib.contains_elements(**other).values())


def _own(lib, kind, target, elem_id, cell="top"):
    """The library's reference as one to an element."""
    null = lambda kind: lit(None).cast(kind)
    r = lib.references.where("target_kind = 'cell'").withColumn("target_kind", lit(kind)).withColumn("target_cell", null("string"))
    return r.withColumn("target_elem_id", lit(target).cast("long")).withColumn("elem_id", lit(elem_id).cast("long")).withColumn("elem_seq", lit(elem_id).cast("long")).withColumn("cell_name", lit(cell) if cell else null("string"))


def _target(spark, elem_id, layer, moved=0.0):
    key = [lit(None).cast("string").alias("cell_name"), lit(elem_id).cast("long").alias("elem_id"), lit(elem_id).cast("long").alias("elem_seq")]
    return spark.range(1).select(*key, *L.polygon([(moved, 0), (moved + 1, 0), (moved + 1, 1)], layer, 0))


def test_equality_through_references(spark):
    lib = make(spark)
    with_target = lambda i, layer, moved=0.0: lib.add_elements(polygons=_target(spark, i, layer, moved), references=_own(lib, "polygon", i, i + 100))
    nested = lambda i, layer: with_target(i, layer).add_elements(references=_own(lib, "reference", i + 100, i + 200, None).unionByName(_own(lib, "reference", i + 200, i + 300, "none")))
    one = with_target(50, 1)
    assert one.equals(with_target(60, 1, 0.00005)) and not one.equals(with_target(50, 1, 0.01))
    assert sorted(r.cell_name for r in one.contains(with_target(60, 7)).collect()) == ["low", "none"]
    deep = nested(50, 1)
    assert sorted(r.cell_name for r in deep.differences(nested(70, 2)).collect()) == ["none", "top"]
    # Membership finds equal targets under other ids, of the same library and of another one.
    ref = _own(lib, "polygon", 60, 1)
    both = one.add_elements(polygons=_target(spark, 60, 1))
    assert both.contains_elements(references=ref)["references"].count() == 1
    assert both.remove_elements(references=ref).references.count() == 1
    assert one.contains_elements(references=ref, targets=with_target(60, 2))["references"].count() == 0
    assert one.contains_elements(references=ref, targets=lib)["references"].count() == 0  # no such target
    other = nested(70, 1)
    assert deep.contains_elements(references=other.references.where("cell_name = 'none'"), targets=other)["references"].count() == 1
    # A cell of another library is only equal if all in it is.
    from dataclasses import replace

    changed = replace(lib, texts=lib.texts.limit(0))
    assert lib.contains_elements(references=lib.references)["references"].count() == 1
    assert lib.contains_elements(references=changed.references, targets=changed)["references"].count() == 0


def test_references_that_target_themselves(spark):
    lib = make(spark)
    loop = lib.add_elements(references=_own(lib, "reference", 20, 20))
    with pytest.raises(ValueError):
        loop.equals(loop)


def test_places_of_a_large_cell(spark, monkeypatch):
    """Numbered over many tasks, places are what one task gives."""
    from planarlake.operators import equality

    n = 500
    rows = spark.range(n, numPartitions=5).select(F.when(L.c("id") % 50 == 0, lit("few")).otherwise(lit("many")).alias("cell_name"), (L.c("id") * 7 % n).alias("elem_seq"), L.c("id").alias("elem_id"))
    want = sorted(tuple(r) for r in equality.ranked(rows).select("cell_name", "elem_id", "place").collect())
    monkeypatch.setattr(equality, "ONE_TASK", 10)
    assert sorted(tuple(r) for r in equality.ranked(rows).select("cell_name", "elem_id", "place").collect()) == want
    assert sorted(p for c, _, p in want if c == "many") == list(range(1, 491))


def test_names_that_repeat(spark):
    lib = make(spark)
    twice = spark.createDataFrame([("q", 5), ("q", 6)], "cell_name string, cell_seq long")
    with pytest.raises(ValueError, match="q"):
        lib.add(twice)
    assert [tuple(r) for r in lib.add(twice, replace_pre_existing=True).cells.where("cell_name = 'q'").collect()] == [("q", 6)]


def test_elements_at_depth_0(spark):
    lib = make(spark)
    assert lib.elements("top", (9, 9), depth=0).references.count() == 0 and lib.elements("top", (3, 1), depth=0).references.count() == 1
    deep = lib.add_elements(references=_own(lib, "reference", 4, 30, "none"))
    assert deep.elements("none", (3, 1), depth=1).references.count() == 25


def test_shown(spark):
    shown = {k: v.collect() for k, v in make(spark).shown().items()}
    grid = "Grid at (10, 0) with 5 columns and 5 rows, spacing ((2, 0), (0, 2)), magnification 1.0, angle 0.0, x_reflection false"
    r = shown["references"][0]
    assert r.text == f"Reference of Cell: low with 1 polygons, 0 paths, 0 references, and 1 texts with {grid}" and r.repr == "Reference(Cell(low))"
    assert shown["polygons"][0].repr == "Polygon([(0, 0), ..., (0, 0)], 3, 1)" and shown["paths"][0].repr == "Path([(0, 0), (0, 1)], 1, 0, Round Ends, 0.5)"
    assert {x.repr for x in shown["cells"]} == {"Cell(top)", "Cell(low)", "Cell(none)"}
    one = make(spark)
    own = lambda kind, i, j: one.references.withColumn("target_kind", lit(kind)).withColumn("target_cell", lit(None).cast("string")).withColumn("target_elem_id", lit(i).cast("long")).withColumn("elem_id", lit(j).cast("long"))
    more = one.add_elements(references=own("polygon", 1, 20).unionByName(own("reference", 20, 21)).unionByName(own("reference", 21, 22)))
    text = {x.elem_id: (x.text, x.repr) for x in more.shown()["references"].collect()}
    poly = "Polygon with 5 point(s), starting at (0, 0) on layer 3, data type 1"
    assert text[20] == (f"Reference of {poly} with {grid}", "Reference(Polygon([(0, 0), ..., (0, 0)], 3, 1))")
    assert text[22] == (f"Reference of Reference of Reference of {poly} with {grid} with {grid} with {grid}", "Reference(Reference(Reference(Polygon([(0, 0), ..., (0, 0)], 3, 1))))")


def test_checks(spark):
    with pytest.raises(ValueError):
        L.path([(0, 0), (1, 1)], path_type=9)
    with pytest.raises(ValueError):
        L.text("x", vertical=3)


def test_libraries_are_kept_apart(spark, tmp_path):
    """Two files with cells of the same names: each top cell places its own cell below."""
    one = spark.range(1)
    key = lambda cell, i: [lit(cell).alias("cell_name"), lit(i).cast("long").alias("elem_id"), lit(i).cast("long").alias("elem_seq")]
    cells = spark.createDataFrame([("TOP", 0), ("SUB", 1)], "cell_name string, cell_seq long")
    square = lambda i: one.select(*key("SUB", i), *L.polygon([(i, 0), (i + 1, 0), (i + 1, 1)], i, 0))
    ref = one.select(*key("TOP", 9), lit("cell").alias("target_kind"), lit("SUB").alias("target_cell"), G.grid((10, 0)).alias("grid"))
    first = L.Library.empty(spark, "first").add(cells).add_elements(polygons=square(1), references=ref)
    second = L.Library.empty(spark, "second").add(cells).add_elements(polygons=square(1).unionByName(square(2)), references=ref)
    first.to_gds(f"file://{tmp_path}/a.gds"), second.to_gds(f"file://{tmp_path}/b.gds")
    with pytest.raises(ValueError):
        L.Library.from_gds(spark, f"{tmp_path}/*.gds")
    assert L.Library.from_gds(spark, f"{tmp_path}/b.gds").name == "second"
    both = L.Libraries.from_gds(spark, f"{tmp_path}/*.gds")
    at = lambda name: next(r.library for r in both.names.collect() if r.library.endswith(name))
    assert sorted((r.library[-5:], r.name) for r in both.names.collect()) == [("a.gds", "first"), ("b.gds", "second")]
    flat = both.flatten()
    got = sorted((r.library[-5:], r.cell_name, r["count"]) for r in flat.tables()["polygons"].groupBy("library", "cell_name").count().collect())
    assert got == [("a.gds", "SUB", 1), ("a.gds", "TOP", 1), ("b.gds", "SUB", 2), ("b.gds", "TOP", 2)]
    assert {(r.library[-5:], r.cell_name, r.max_x) for r in both.bounding_boxes().collect()} == {("a.gds", "SUB", 2), ("a.gds", "TOP", 12), ("b.gds", "SUB", 3), ("b.gds", "TOP", 13)}
    assert {(r.library[-5:], r.cell_name, r.is_on) for r in both.is_on([(1, 0)]).collect()} == {("a.gds", "SUB", True), ("a.gds", "TOP", True), ("b.gds", "SUB", False), ("b.gds", "TOP", False)}
    assert {(r.library[-5:], r.cell_name, r.below) for r in both.reachable().where("cell_name <> below").collect()} == {("a.gds", "TOP", "SUB"), ("b.gds", "TOP", "SUB")}
    text = {(r.library[-5:], r.text.split(" with Grid")[0], r.repr) for r in both.shown()["references"].collect()}
    assert ("b.gds", "Reference of Cell: SUB with 2 polygons, 0 paths, 0 references, and 0 texts", "Reference(Cell(SUB))") in text and len(text) == 2
    own = both.library(at("b.gds"))
    assert own.name == "second" and own.equals(second) and not own.equals(first)
    assert {r.target_cell for r in own.references.collect()} == {"SUB"}
    again = L.Libraries.of({"a": first, "b": second})
    other = L.Libraries.of({"a": first, "b": replace_polygons(second)})
    assert sorted(tuple(r) for r in again.differences(other).collect()) == [("b", "SUB"), ("b", "TOP")]
    assert L.Library.from_gds(spark, both.scale(2).to_gds(at("a.gds"), f"file://{tmp_path}/c.gds")).bounding_boxes().where("cell_name = 'TOP'").first().max_x == 28


def replace_polygons(lib):
    from dataclasses import replace

    return replace(lib, polygons=lib.polygons.withColumn("layer", lit(9)))
