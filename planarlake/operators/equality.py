"""Equality by value, through references: of cells, of libraries, and of references as members.

Elements are held against each other by their place in the cell (or, as members, by keys that equal ones share), with
exact fields and closeness by epsilon. A reference is equal if its grid is and its target is: targets that are elements are
followed pair by pair, level by level; a cell below that differs makes every cell above it differ. Targets have digests
of their exact fields, from the innermost outwards, as join keys: epsilon can't break them, and what they bring together
is verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import point as P
from ..staging import staged
from . import hierarchy
from .catalog import CLOSE, EXACT, KINDS, anchor, close, near

#: Elements of one cell that one task numbers; larger cells are numbered over many.
ONE_TASK = 1_000_000
ELEMENTS = {"polygon": "polygons", "path": "paths", "text": "texts"}
c = F.col


def largest(tables: list[DataFrame]) -> list[int]:
    """The most elements that a cell has in each of the tables, in one job."""
    per = [t.where("cell_name is not null").groupBy("cell_name").count().select(F.lit(i).alias("i"), "count") for i, t in enumerate(tables)]
    got = {r.i: r.most for r in reduce(DataFrame.union, per).groupBy("i").agg(F.max("count").alias("most")).collect()}
    return [got.get(i, 0) for i in range(len(tables))]


def ranked(t: DataFrame, most: int | None = None) -> DataFrame:
    """Elements with their place in their cell, from 1, in order of elem_seq and elem_id.

    Where a cell is large, rows are sorted over all tasks and written; a row's place is then its number within its part of
    its cell after the counts of the parts before. Elements of no cell (mere targets) have no place and are left out.
    """
    t = t.where("cell_name is not null")
    order = [c(k) for k in ("elem_seq", "elem_id") if k in t.columns]
    most = largest([t])[0] if most is None else most
    if most <= ONE_TASK:
        return t.withColumn("place", F.row_number().over(Window.partitionBy("cell_name").orderBy(*order)).cast("long"))
    rows = staged(t.orderBy("cell_name", *order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("cell_name", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("cell_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("cell_name", "part", (F.coalesce(before, F.lit(0)) - c("first") + 1).alias("shift"))
    return rows.join(parts, ["cell_name", "part"]).withColumn("place", c("at") + c("shift")).drop("at", "part", "shift")


def _same(kind: str, epsilon: float, skip: tuple[str, ...] = ()) -> Column:
    """Whether two elements of a kind in one row (columns a_, b_ and in_a, in_b) are equal, targets aside."""
    same = c("in_a") & c("in_b") & close(kind, c(f"a_{CLOSE[kind]}"), c(f"b_{CLOSE[kind]}"), epsilon)
    for k in EXACT[kind]:
        if k not in skip:
            same = same & c(f"a_{k}").eqNullSafe(c(f"b_{k}"))
    return F.coalesce(same, F.lit(False))


def _side(t: DataFrame, kind: str, prefix: str, *keys: Column) -> DataFrame:
    return t.select(*keys, *[c(k).alias(f"{prefix}_{k}") for k in (*EXACT[kind], CLOSE[kind]) if k in t.columns], F.lit(True).alias(f"in_{prefix}"))


def by_place(left: DataFrame, right: DataFrame, kind: str, epsilon: float = P.EPSILON, most: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(cell_name, place, equal) of all places of two tables of a kind; with the targets of either side for references,
    which count here by kind and cell."""
    a, b = (_side(ranked(t, n), kind, p, c("cell_name"), c("place")) for t, p, n in ((left, "a", most[0]), (right, "b", most[1])))
    both = a.join(b, ["cell_name", "place"], "full_outer").withColumn("equal", _same(kind, epsilon, ("target_elem_id",)))
    kept = ["a_target_kind", "a_target_elem_id", "b_target_elem_id"] if kind == "references" else []
    return both.select("cell_name", "place", "equal", *kept)


def unequal_elements(left: DataFrame, right: DataFrame, kind: str, epsilon: float = P.EPSILON) -> DataFrame:
    """(cell_name, place) where two tables of a kind differ, targets that are elements aside."""
    return by_place(left, right, kind, epsilon).where("not equal").select("cell_name", "place")


def unequal_targets(pairs: DataFrame, left: dict[str, DataFrame], right: dict[str, DataFrame], epsilon: float = P.EPSILON) -> DataFrame:
    """(owner) of the pairs (owner, kind, a, b) whose targets a of left and b of right, elements of that kind, differ.

    References as targets are followed to theirs, round by round, as far as they go; one that comes back to itself fails.
    Cells that references name count by name. A target that isn't there equals nothing.
    """
    bad, todo, rounds = [], pairs.select("owner", "kind", "a", "b").distinct(), 0
    most = None
    while True:
        for name, kind in ELEMENTS.items():
            met = todo.where(c("kind") == name).join(_side(left[kind], kind, "a", c("elem_id").alias("a")), "a", "left")
            met = met.join(_side(right[kind], kind, "b", c("elem_id").alias("b")), "b", "left")
            bad.append(met.where(~_same(kind, epsilon)).select("owner"))
        nested = todo.where("kind = 'reference'")
        if not nested.limit(1).count():
            return reduce(DataFrame.union, bad).distinct()
        most = left["references"].count() if most is None else most
        if rounds > most:
            raise ValueError("reference refers to itself")
        met = nested.join(_side(left["references"], "references", "a", c("elem_id").alias("a")), "a", "left")
        met = staged(met.join(_side(right["references"], "references", "b", c("elem_id").alias("b")), "b", "left").withColumn("equal", _same("references", epsilon, ("target_elem_id",))), "nested")
        bad.append(met.where("not equal").select("owner"))
        todo = met.where("equal and a_target_kind <> 'cell'").select("owner", c("a_target_kind").alias("kind"), c("a_target_elem_id").alias("a"), c("b_target_elem_id").alias("b")).distinct()
        rounds += 1


def unequal_cells(left: dict[str, DataFrame], right: dict[str, DataFrame], epsilon: float = P.EPSILON) -> DataFrame:
    """Names of cells that differ: in an element of some kind, in what a reference targets, or in a cell below them."""
    most = largest([t[k] for k in KINDS for t in (left, right)])
    places = {k: by_place(left[k], right[k], k, epsilon, (most[2 * i], most[2 * i + 1])) for i, k in enumerate(KINDS)}
    refs = places["references"] = staged(places["references"], "places")
    bad = reduce(DataFrame.union, [p.where("not equal").select("cell_name") for p in places.values()])
    pairs = refs.where("equal and a_target_kind <> 'cell'")
    if pairs.limit(1).count():
        pairs = pairs.select(c("cell_name").alias("owner"), c("a_target_kind").alias("kind"), c("a_target_elem_id").alias("a"), c("b_target_elem_id").alias("b"))
        bad = bad.union(unequal_targets(pairs, left, right, epsilon).withColumnRenamed("owner", "cell_name"))
    bad = staged(bad.distinct(), "unequal")
    if not refs.limit(1).count() or not bad.limit(1).count():
        return bad
    return bad.union(hierarchy.above(left["references"], bad)).distinct()


def digests(t: dict[str, DataFrame]) -> DataFrame:
    """(target_kind, target_elem_id, digest) of all elements that references can target: hashes of what must be exactly
    equal in them, and of the digests of what they target themselves, level by level from the innermost."""
    parts = []
    for name, kind in ELEMENTS.items():
        own = [c(k) for k in EXACT[kind]] + ([F.size("points")] if CLOSE[kind] == "points" else [])
        parts.append(t[kind].select(F.lit(name).alias("target_kind"), c("elem_id").alias("target_elem_id"), F.xxhash64(F.lit(name), *own).alias("digest")))
    known = reduce(DataFrame.union, parts)
    inner = t["references"].where("target_kind = 'reference'").select(c("target_elem_id").alias("elem_id")).distinct()
    todo = t["references"].join(inner, "elem_id", "left_semi")
    if not todo.limit(1).count():
        return known
    grid = [c(f"grid.{k}") for k in ("columns", "rows", "x_reflection")]
    shown = lambda d, low: d.select(F.lit("reference").alias("target_kind"), c("elem_id").alias("target_elem_id"), F.xxhash64(F.lit("reference"), *grid, c("target_kind"), low).alias("digest"))
    new = staged(shown(todo.where("target_kind = 'cell'"), c("target_cell")).union(shown(todo.join(known, ["target_kind", "target_elem_id"]), c("digest"))), "digests")
    every, rest = known.union(new), todo.where("target_kind = 'reference'")
    while new.limit(1).count():
        new = staged(shown(rest.join(new, ["target_kind", "target_elem_id"]), c("digest")), "digests")
        every = every.union(new)
    return every


def _by_value(rows: DataFrame, members: DataFrame, rows_t: dict[str, DataFrame], members_t: dict[str, DataFrame], epsilon: float) -> DataFrame:
    """(row) of the numbered references to elements that equal a member by value."""
    keys = ["cell_name", "target_kind", "digest"]
    on = ["target_kind", "target_elem_id"]
    mine = rows.join(digests(rows_t), on)
    theirs = members.join(digests(members_t), on)
    pairs = near(mine, theirs, epsilon, keys, "inner", "references", ("target_elem_id",))
    owner = F.struct(c("row"), c("target_elem_id").alias("a"), c("r_target_elem_id").alias("b"))
    pairs = staged(pairs.select("row", owner.alias("owner"), c("target_kind").alias("kind"), c("target_elem_id").alias("a"), c("r_target_elem_id").alias("b")), "candidates")
    return pairs.join(unequal_targets(pairs, rows_t, members_t, epsilon), "owner", "left_anti").select("row").distinct()


def references_among(rows: DataFrame, members: DataFrame, rows_t: dict[str, DataFrame], members_t: dict[str, DataFrame], epsilon: float = P.EPSILON, among: bool = True) -> DataFrame:
    """The references that equal a member of the same cell (among: or those that don't), by value.

    rows_t and members_t are the libraries that the targets of either side are in; where they are one, a cell equals itself.
    """
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    to_cell = c("target_kind") == "cell"
    found = near(rows.where(to_cell), members.where(to_cell), epsilon, ["cell_name", "target_kind", "target_cell"], "left_semi", "references")
    if rows_t is not members_t:
        found = found.join(unequal_cells(rows_t, members_t, epsilon).withColumnRenamed("cell_name", "target_cell"), "target_cell", "left_anti")
    found = found.select("row")
    if rows.where(~to_cell).limit(1).count():
        found = found.union(_by_value(rows.where(~to_cell), members.where(~to_cell), rows_t, members_t, epsilon))
    return rows.join(found, "row", "left_semi" if among else "left_anti").drop("row")
