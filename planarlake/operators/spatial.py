"""Spatial joins by tiles: equal tile numbers join, boxes and the exact test decide.

A plain box condition would become a nested-loop join. Here polygons go to the tiles that their boxes meet, points to
theirs, and the join is on the tile. Tile joins are ordinary equi-joins, so that skewed tiles are split at run time.

Tiles come in levels, each with tiles of four times the side of the one before. Without a tile size each polygon takes the
level at which a tile is as large as its box, or up to four times that: it meets four tiles at most, and however
crowded a spot is, its tiles are as fine as what stands there. With a tile size that is the finest level, and polygons
larger than MANY tiles a side take coarser ones. Points and polygons are held against all levels present, and there is no
coarsest one, so that no polygon goes to more than MANY x MANY tiles.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ring
from ..staging import staged
from . import boxes, counting, pairing

MANY = 8
#: Points, or polygons, of a tile that one task counts at once.
IN_TILE = 250_000
#: Levels below the one up to which one in so many polygons is smaller share its tiles.
RARE = 16
#: Points of a ring that one fold goes through for each point tested.
LARGE = 512
#: What a box counts for at least, as a share of how far out it is: tiles' numbers stay exact.
LEAST = 2.0**-36


def _side(tile: float | None, level: Column) -> Column:
    return F.lit(1.0 if tile is None else float(tile)) * F.pow(F.lit(4.0), level)


def _boxed(df: DataFrame, tile: float | None) -> DataFrame:
    """Polygons with their boxes and levels (where a box meets few tiles), staged: levels are asked for before the join."""
    df = boxes.polygon_boxes(df)
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    size = F.greatest(size, F.lit(1e-9), *[F.abs(F.col(k)) * LEAST for k in boxes.BOX])
    fits = F.ceil(F.log(size / (1.0 if tile is None else tile * (MANY - 1))) / F.log(F.lit(4.0))).cast("int")
    return staged(df.withColumn("level", fits if tile is None else F.greatest(F.lit(0), fits)), "boxed")


def _tiles(df: DataFrame, tile: float | None) -> DataFrame:
    """One row a tile of the row's level that the box meets."""
    side = _side(tile, F.col("level"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))
    return df.withColumn("tx", F.explode(span("min_x", "max_x"))).withColumn("ty", F.explode(span("min_y", "max_y")))


def levels_of(boxed: DataFrame) -> list[int]:
    """The levels present; there are about half as many as sizes have binary orders of magnitude."""
    return sorted(r.level for r in boxed.select("level").distinct().collect())


def point_in_polygon(points: DataFrame, polygons: DataFrame, tile: float | None = None, x: str = "px", y: str = "py") -> DataFrame:
    """All (point, polygon) rows where the polygon (column points) contains the point, edges included.

    Columns of both inputs come out; their names must differ. Rings of more than LARGE points are tested edge by edge over
    slabs instead of as a whole.
    """
    boxed = _boxed(polygons.withColumn("ring", F.monotonically_increasing_id()), tile)
    levels = F.array(*[F.lit(v) for v in levels_of(boxed)]).cast("array<int>")
    side = _side(tile, F.col("level"))
    probes = points.withColumn("level", F.explode(levels)).withColumn("tx", F.floor(F.col(x) / side)).withColumn("ty", F.floor(F.col(y) / side))
    inside = (F.col(x) >= F.col("min_x")) & (F.col(x) <= F.col("max_x")) & (F.col(y) >= F.col("min_y")) & (F.col(y) <= F.col("max_y"))
    meet = lambda some: probes.join(_tiles(some, tile), ["level", "tx", "ty"]).where(inside).drop("level", "tx", "ty")
    is_large = F.size("points") > LARGE
    met = meet(boxed.where(~is_large)).where(ring.contains(F.col("points"), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))))
    large = boxed.where(is_large)
    if large.limit(1).count():
        met = met.unionByName(_by_slabs(meet(large.drop("points")), large, x, y))
    return met.drop("ring", *boxes.BOX)


def points_in_polygons(points: DataFrame, polygons: DataFrame, tile: float | None = None, x: str = "px", y: str = "py") -> DataFrame:
    """(elem_id, n_points) of the polygons (elem_id, points) that contain some of the points, edges included.

    The counts of point_in_polygon, without its rows: these grow with the square of the tables. Each tile's points and
    polygons meet in one task, where the work goes by polygons (counting). Counts add up, so that tiles with more than
    IN_TILE points or polygons are dealt out by hashes, each part of the points against each of the polygons.
    """
    key = ["level", "tx", "ty"]
    coarse = None if tile is None else tile * 4
    boxed = _boxed(polygons.select("elem_id", "points"), coarse)
    if tile is None:
        boxed = boxed.withColumn("level", F.col("level") + 1)
    side = _side(coarse, F.col("level"))
    spots = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    found = sorted((r.level, r["count"]) for r in boxed.where("level is not null").groupBy("level").count().collect())
    seen = list(accumulate(n for _, n in found))
    least = next((v for (v, _), n in zip(found, seen) if n >= seen[-1] / RARE), 0)  # smaller ones take its tiles: few tiles have little in them
    boxed = boxed.withColumn("level", F.greatest(F.col("level"), F.lit(least)))
    levels = F.array(*[F.lit(v) for v, _ in found if v >= least]).cast("array<int>")
    spots = spots.withColumn("level", F.explode(levels)).withColumn("tx", F.floor(F.col("x") / side)).withColumn("ty", F.floor(F.col("y") / side))
    rings = _tiles(boxed, coarse).select("elem_id", "points", *key)
    spots = spots.join(rings.select(*key).distinct(), key, "left_semi")
    spots, rings = _dealt(spots, rings, "p", F.xxhash64("x", "y"), key)
    rings, spots = _dealt(rings, spots, "q", F.xxhash64("elem_id"), key)
    key = [*key, "p", "q"]
    kind = boxed.schema["elem_id"].dataType.simpleString()
    met = spots.groupBy(*key).cogroup(rings.groupBy(*key)).applyInArrow(counting.in_tile, f"elem_id {kind}, n_points long")
    return met.groupBy("elem_id").agg(F.sum("n_points").alias("n_points"))


def _dealt(rows: DataFrame, others: DataFrame, part: str, h: Column, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables with a part: rows of crowded tiles get one by their hash, others go to all parts of their tile."""
    crowded = rows.groupBy(*key).count().where(F.col("count") > IN_TILE).select(*key, F.ceil(F.col("count") / IN_TILE).cast("int").alias("n"))
    crowded = staged(crowded, "crowded")
    if not crowded.limit(1).count():
        return rows.withColumn(part, F.lit(0)), others.withColumn(part, F.lit(0))
    n = F.coalesce("n", F.lit(1))
    with_n = lambda t: t.join(F.broadcast(crowded), key, "left")
    return with_n(rows).withColumn(part, F.pmod(h, n).cast("int")).drop("n"), with_n(others).withColumn(part, F.explode(F.sequence(F.lit(0), n - 1))).drop("n")


def _by_slabs(met: DataFrame, large: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of points met with large rings (by boxes) for which the ring contains the point.

    A ring's edges are dealt out over slabs of its height, as many as the root of its points; a point is held against the
    edges of its own slab, and crossings are counted up by point and ring.
    """
    c = F.col
    met = staged(met.withColumn("hit", F.monotonically_increasing_id()), "met")
    slabs = large.select("ring", "min_y", (F.ceil(F.sqrt(F.size("points"))) / F.greatest(c("max_y") - c("min_y"), F.lit(1e-300))).alias("per"), F.explode(ring.edges(c("points"))).alias("e"))
    at = lambda v, low, per: F.floor((v - low) * per)
    low, high = F.least(c("e.a.y"), c("e.b.y")), F.greatest(c("e.a.y"), c("e.b.y"))
    slabs = slabs.select("ring", "e", F.explode(F.sequence(at(low, c("min_y"), c("per")), at(high, c("min_y"), c("per")))).alias("slab"))
    rings = large.select("ring", (F.ceil(F.sqrt(F.size("points"))) / F.greatest(c("max_y") - c("min_y"), F.lit(1e-300))).alias("per"))
    mine = met.join(rings, "ring").select("hit", "ring", c(x).alias("x"), c(y).alias("y"), at(c(y), c("min_y"), c("per")).alias("slab"))
    both = mine.join(slabs, ["ring", "slab"])
    per = both.groupBy("hit").agg(F.count_if(ring.crosses(c("x"), c("y"), c("e.b"), c("e.a"))).alias("n"), F.max(ring.on_segment(c("x"), c("y"), c("e.a"), c("e.b"))).alias("edge"))
    good = per.where(c("edge") | (c("n") % 2 == 1)).select("hit")
    return met.join(good, "hit", "left_semi").drop("hit").join(large.select("ring", "points"), "ring")


def polygon_pairs(left: DataFrame, right: DataFrame, tile: float | None = None, distinct: bool = False) -> DataFrame:
    """(a, b) ids of polygons of two tables (elem_id, points) that intersect by vertices: each pair once.

    A pair that meets in several tiles counts in the one that holds the corner where the two boxes begin to overlap. Where
    levels differ, the finer side goes to the coarser level's tiles too. Points go to the tiles with their boxes, where pairs
    are tested at once (pairing): pairs of boxes grow with the square of the tables, and are never shuffled. Tiles with more
    than IN_TILE points are dealt out in parts, each against each. distinct leaves only pairs with a below b.
    """
    coarse = None if tile is None else tile * 4
    odd = F.exists("points", lambda p: ~F.coalesce((F.abs(p["x"]) < pairing.HUGE) & (F.abs(p["y"]) < pairing.HUGE), F.lit(False)))
    boxed = lambda t: _boxed(t.select("elem_id", "points", odd.alias("odd")), coarse).where("level is not null")
    one = boxed(left)
    two = one if left is right else boxed(right)
    found = {(r.level, r.odd) for t in ((one,) if one is two else (one, two)) for r in t.select("level", "odd").distinct().collect()}
    levels = sorted({v for v, is_odd in found if not is_odd})
    marked = lambda t, a, b: t.where("not odd").drop("odd").withColumn("is_left", F.lit(a)).withColumn("is_right", F.lit(b))
    rows = marked(one, True, True) if one is two else marked(one, True, False).unionByName(marked(two, False, True))
    rows = _in_parts(_coarser(rows, levels, coarse), coarse)
    both = one is not two or not distinct
    kind = rows.schema["elem_id"].dataType.simpleString()
    key = ["level", "tx", "ty", "p", "q"]
    pairs = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda batches: pairing.in_tiles(batches, both), f"a {kind}, b {kind}")
    if not both:  # two rows that have met once, in any order
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    every = sorted({v for v, _ in found})
    if any(is_odd for _, is_odd in found):
        pairs = pairs.unionByName(_by_rows(one.where("odd"), two, every, coarse)).unionByName(_by_rows(one.where("not odd"), two.where("odd"), every, coarse))
    return pairs.where("a < b") if distinct else pairs


def _in_parts(rows: DataFrame, tile: float | None) -> DataFrame:
    """Rows of tiles by the groups (p, q) in which they are held against each other, as pairing has them.

    All of a tile is one group; a crowded one has groups for each two parts of the rows of its own level, and for each of
    these with each part of the finer levels' rows, which needn't meet each other."""
    c = F.col
    key = ["level", "tx", "ty"]
    rows = rows.withColumn("is_own", c("own") == c("level"))
    points = lambda own: F.sum(F.when(c("is_own") == own, F.size("points")).otherwise(0))
    sums = rows.groupBy(*key).agg(points(True).alias("n_own"), points(False).alias("n_finer")).where(c("n_own") + c("n_finer") > IN_TILE)
    crowded = staged(sums.select(*key, *[F.ceil(c(k) / IN_TILE).cast("int").alias(k) for k in ("n_own", "n_finer")]), "crowded")
    side = _side(tile, c("level"))
    rows = rows.join(F.broadcast(crowded), key, "left").where("n_own is null or n_own > 0")
    h = F.xxhash64("elem_id", *boxes.BOX)
    part = F.when(c("n_own").isNull(), 0).when(c("is_own"), F.pmod(h, c("n_own"))).otherwise(c("n_own") + F.pmod(h, c("n_finer"))).cast("int")
    last = F.when(c("n_own").isNull(), 0).when(c("is_own"), c("n_own") + c("n_finer") - 1).otherwise(c("n_own") - 1)
    begins = [(F.floor(c(f"min_{k}") / side) == c(f"t{k}")).alias(f"in_{k}") for k in "xy"]
    rows = rows.select("elem_id", "points", "is_left", "is_right", c("is_own").alias("own"), *begins, *key, part.alias("part"), F.explode(F.sequence(F.lit(0), last)).alias("o"))
    return rows.withColumn("p", F.least("part", "o")).withColumn("q", F.greatest("part", "o")).drop("o")


def _by_rows(one: DataFrame, two: DataFrame, levels: list[int], tile: float | None) -> DataFrame:
    """The pairs of polygons with boxes and levels, row by row: for coordinates that are missing, infinite or not numbers."""
    a, b = (_coarser(t, levels, tile).select(*[F.col(c).alias(f"{p}_{c}") for c in ("elem_id", "own", "points", *boxes.BOX)], "level", "tx", "ty") for p, t in (("a", one), ("b", two)))
    met = a.join(b, ["level", "tx", "ty"]).where(F.col("level") == F.greatest("a_own", "b_own"))
    side = _side(tile, F.col("level"))
    x0, y0 = F.greatest("a_min_x", "b_min_x"), F.greatest("a_min_y", "b_min_y")
    overlap = (x0 <= F.least("a_max_x", "b_max_x")) & (y0 <= F.least("a_max_y", "b_max_y"))
    once = (F.floor(x0 / side) == F.col("tx")) & (F.floor(y0 / side) == F.col("ty"))
    return met.where(overlap & once & ring.intersects(F.col("a_points"), F.col("b_points"))).select(F.col("a_elem_id").alias("a"), F.col("b_elem_id").alias("b"))


def _coarser(boxed: DataFrame, levels: list[int], tile: float | None) -> DataFrame:
    """Rows of the tiles of their own level and of all coarser ones present."""
    base = boxed.withColumnRenamed("level", "own")
    base = base.withColumn("level", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<int>"), lambda v: v >= F.col("own"))))
    return _tiles(base, tile)
