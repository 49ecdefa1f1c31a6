"""Hierarchy: placements composed along references, then applied to elements once.

A copy of a cell under a reference is an affine map p -> A p + t. Maps along a chain of references multiply, so that the
tree of placements (small) is walked by joins level by level, and geometry is touched in one join at the end. Text angles
and sizes, and references left over at the depth limit, follow rules of their own, carried along as plain numbers.

A level is a join of the frontier with the reference table and an explode over the array; levels are written to the
shared folder, so that lineage stays short and lost executors cost little. How deep it goes is known beforehand from the
graph of distinct cells, whose paths are doubled in length round by round; cycles fail there.

A reference may have a reference as its target. The target then stands for a cell of its own, which has nothing else in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import point as P
from ..functions import ring
from ..staging import staged
from . import boxes, filters

#: Beginning of the names of cells that stand for targeted references; no file has such names.
NESTED = "\0reference "
#: Distinct pairs of cells whose depth the driver finds out; of more, Spark does.
WALKED = 100_000
#: Copies of one array that a task makes, about.
TASK_COPIES = 1_000_000
STATE = ("a", "b", "c", "d", "tx", "ty", "a0", "b0", "c0", "d0", "tx0", "ty0", "turn", "spin", "sign", "size", "flip")


def start(cells: DataFrame) -> DataFrame:
    """Placements of root cells (column root): the identity."""
    one = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0, "tx": 0.0, "ty": 0.0, "a0": 1.0, "b0": 0.0, "c0": 0.0, "d0": 1.0, "tx0": 0.0, "ty0": 0.0, "turn": 0.0, "spin": 0.0, "sign": 1.0, "size": 1.0}
    return cells.select(
        "root", F.col("root").alias("cell_name"), F.lit(0).alias("depth"),
        *[F.lit(v).alias(k) for k, v in one.items()], F.lit(False).alias("flip"),
    )


def _copies(grid: Column = None):
    g = F.col("grid") if grid is None else grid
    return (
        F.explode(F.sequence(F.lit(0).cast("long"), g["columns"] - 1)).alias("column"),
        F.explode(F.sequence(F.lit(0).cast("long"), g["rows"] - 1)).alias("row"),
    )


def expand(references: DataFrame, corners: bool = False) -> DataFrame:
    """References with one row a copy (column, row): the copies' own maps beside the grid. Empty grids place nothing.

    Arrays of very many copies are dealt out over tasks by their columns before the rows are made. corners: only the copies
    at the corners of the array, between which all others lie.
    """
    g = F.col("grid")
    df = references.where((g["columns"] > 0) & (g["rows"] > 0))
    if corners:
        ends = lambda n: F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), n - 1)))
        return _mapped(df.select("*", ends(g["columns"]).alias("column")).select("*", ends(g["rows"]).alias("row")))
    most = df.agg(F.max(g["columns"] * g["rows"])).first()[0] or 0
    column, row = _copies()
    df = df.select("*", column)
    if most > TASK_COPIES:
        df = df.repartition(min(10_000, int(most // TASK_COPIES) + 1))
    return _mapped(df.select("*", row))


def _mapped(df: DataFrame) -> DataFrame:
    """Copies (grid, column, row) with their maps."""
    g = F.col("grid")
    s, k = P.sin_cos(g["angle"])
    m, r = g["magnification"], F.when(g["x_reflection"], -1.0).otherwise(1.0)
    at = G.place(g, F.col("column"), F.col("row"))
    return df.select(
        "*", (m * k).alias("ga"), (-m * s * r).alias("gb"), (m * s).alias("gc"), (m * k * r).alias("gd"), (-m * s).alias("gb0"), (m * k).alias("gd0"),
        at["x"].alias("gtx"), at["y"].alias("gty"), r.alias("gr"),
    )


def _compose() -> dict[str, Column]:
    """The parent's map after the copy's."""
    c = F.col
    return {
        "a": c("a") * c("ga") + c("b") * c("gc"), "b": c("a") * c("gb") + c("b") * c("gd"), "c": c("c") * c("ga") + c("d") * c("gc"), "d": c("c") * c("gb") + c("d") * c("gd"),
        "tx": c("a") * c("gtx") + c("b") * c("gty") + c("tx"), "ty": c("c") * c("gtx") + c("d") * c("gty") + c("ty"),
        "a0": c("a0") * c("ga") + c("b0") * c("gc"), "b0": c("a0") * c("gb0") + c("b0") * c("gd0"), "c0": c("c0") * c("ga") + c("d0") * c("gc"), "d0": c("c0") * c("gb0") + c("d0") * c("gd0"),
        "tx0": c("a0") * c("gtx") + c("b0") * c("gty") + c("tx0"), "ty0": c("c0") * c("gtx") + c("d0") * c("gty") + c("ty0"),
        "turn": c("turn") + c("sign") * c("grid.angle"), "spin": c("spin") + c("grid.angle"), "sign": c("sign") * c("gr"), "size": c("size") * c("grid.magnification"), "flip": c("flip") != c("grid.x_reflection"),
    }


def with_nested(references: DataFrame) -> DataFrame:
    """References in which those to references have become references to cells of their own, each with the target."""
    nested = references.where("target_kind = 'reference'")
    if not nested.limit(1).count():
        return references
    name = lambda c: F.concat(F.lit(NESTED), c.cast("string"))
    wanted = nested.select(F.col("target_elem_id").alias("elem_id")).distinct()
    inner = references.join(wanted, "elem_id", "left_semi").withColumn("cell_name", name(F.col("elem_id")))
    every = references.where("cell_name is not null").unionByName(inner)
    is_nested = F.col("target_kind") == "reference"
    return every.withColumn("target_cell", F.when(is_nested, name(F.col("target_elem_id"))).otherwise(F.col("target_cell"))).withColumn("target_kind", F.when(is_nested, "cell").otherwise(F.col("target_kind")))


def without_nested(references: DataFrame) -> DataFrame:
    """The opposite: references to cells that stand for references have those as their targets again."""
    is_nested = F.col("target_cell").startswith(NESTED)
    out = references.withColumn("target_kind", F.when(is_nested, "reference").otherwise(F.col("target_kind")))
    return out.withColumn("target_cell", F.when(~F.coalesce(is_nested, F.lit(False)), F.col("target_cell")))


def closure(references: DataFrame) -> DataFrame:
    """(cell_name, below, steps) of all cells under each cell, and the most references on a way there; cycles fail.

    Pairs of cells are few beside placements. Each round joins ways of up to so many steps with each other, so that a
    hierarchy of depth d takes log2(d) rounds; however many ways lead from one cell to another, they are one row.
    """
    edges = references.where("target_kind = 'cell' and target_cell is not null")
    known = staged(edges.select("cell_name", F.col("target_cell").alias("below")).distinct().withColumn("steps", F.lit(1)))
    size = F.count(F.lit(1)).alias("n"), F.sum("steps").alias("steps"), F.min(F.when(F.col("cell_name") == F.col("below"), F.col("below"))).alias("looped")
    now = known.agg(*size).first()
    while now.n:
        if now.looped is not None:
            raise ValueError(f"cell refers to itself: {now.looped}")
        step = known.select(F.col("cell_name").alias("below"), F.col("below").alias("further"), F.col("steps").alias("more"))
        longer = known.join(step, "below").select("cell_name", F.col("further").alias("below"), (F.col("steps") + F.col("more")).alias("steps"))
        known = staged(known.union(longer).groupBy("cell_name", "below").agg(F.max("steps").alias("steps")))
        before, now = now, known.agg(*size).first()
        if now == before:
            break
    return known


def _edges(references: DataFrame) -> tuple[DataFrame, list | None]:
    """Distinct (cell_name, target_cell), as a table, and as rows on the driver if there are WALKED at most."""
    edges = references.where("target_kind = 'cell' and target_cell is not null").select("cell_name", "target_cell").distinct()
    few = edges.limit(WALKED + 1).collect()
    return edges, few if len(few) <= WALKED else None


def _walked(edges: list, begin: list[str]) -> set[str]:
    """All that is reached from some names over (from, to)."""
    on: dict[str, list[str]] = {}
    for a, b in edges:
        on.setdefault(a, []).append(b)
    found: set[str] = set()
    todo = list(begin)
    while todo:
        new = [x for x in on.get(todo.pop(), ()) if x not in found]
        found.update(new)
        todo += new
    return found


def deepest(references: DataFrame, roots: DataFrame) -> int:
    """The most references on a way down from a root; a cell under itself fails."""
    edges, few = _edges(references)
    if few is None:
        return closure(references).join(roots.select(F.col("root").alias("cell_name")), "cell_name", "left_semi").agg(F.max("steps")).first()[0] or 0
    below = _lists(few)
    if not below:
        return 0
    tops = [r.root for r in roots.join(edges, roots.root == edges.cell_name, "left_semi").select("root").distinct().collect()]
    found = _depths(below, tops)
    return max((found[t] for t in tops), default=0)


def _lists(edges: list) -> dict[str, list[str]]:
    below: dict[str, list[str]] = {}
    for r in edges:
        below.setdefault(r.cell_name, []).append(r.target_cell)
    return below


def _depths(below: dict[str, list[str]], tops) -> dict[str, int]:
    """The most references on a way down from each cell that is met from the tops on; cycles fail."""
    depth: dict[str, int | None] = {}  # None while a cell is under way
    for top in tops:
        path = [] if top in depth else [(top, iter(below.get(top, ())))]
        depth.setdefault(top, None)
        while path:
            cell, rest = path[-1]
            low = next(rest, None)
            if low is None:
                depth[cell] = max((depth[x] + 1 for x in below.get(cell, ())), default=0)
                path.pop()
            elif low not in depth:
                depth[low] = None
                path.append((low, iter(below.get(low, ()))))
            elif depth[low] is None:
                raise ValueError(f"cell refers to itself: {low}")
    return depth


def above(references: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_name) of all cells over the given ones (cell_name), references to references followed; cycles fail."""
    references = with_nested(references)
    edges, few = _edges(references)
    if few is None:
        up = closure(references).join(cells.select(F.col("cell_name").alias("below")), "below", "left_semi").select("cell_name").distinct()
        return up.where(~F.col("cell_name").startswith(NESTED))
    begin = cells.join(edges, cells.cell_name == edges.target_cell, "left_semi").select("cell_name").distinct().collect()
    found = _walked([(r.target_cell, r.cell_name) for r in few], [r.cell_name for r in begin])
    return references.sparkSession.createDataFrame([(x,) for x in sorted(found) if not x.startswith(NESTED)], "cell_name string")


#: Levels up to which placements are joined in one plan; more are staged round by round.
PLANNED = 3


def _step(references: DataFrame) -> DataFrame:
    """(parent, target_cell, STATE): the map of every copy of every reference to a cell."""
    c = F.col
    one = {"a": "ga", "b": "gb", "c": "gc", "d": "gd", "tx": "gtx", "ty": "gty", "a0": "ga", "b0": "gb0", "c0": "gc", "d0": "gd0", "tx0": "gtx", "ty0": "gty", "turn": "grid.angle", "spin": "grid.angle", "sign": "gr", "size": "grid.magnification", "flip": "grid.x_reflection"}
    return expand(references.where("target_kind = 'cell'")).select(c("cell_name").alias("parent"), "target_cell", *[c(v).alias(k) for k, v in one.items()])


def _after(above: DataFrame, below: DataFrame, *keys: Column) -> DataFrame:
    """Maps of ways that go on: those of above (to cell_name), then those of below (from parent to target_cell)."""
    low = below.select(F.col("parent").alias("n_parent"), F.col("target_cell").alias("n_target"), *[F.col(k).alias(f"n_{k}") for k in STATE])
    c, n = F.col, lambda k: F.col(f"n_{k}")
    out = {}
    for z in ("", "0"):  # with mirrors and without
        a, b, d, e = (c(k + z) for k in "abcd")
        out |= {f"a{z}": a * n(f"a{z}") + b * n(f"c{z}"), f"b{z}": a * n(f"b{z}") + b * n(f"d{z}"), f"c{z}": d * n(f"a{z}") + e * n(f"c{z}"), f"d{z}": d * n(f"b{z}") + e * n(f"d{z}")}
        out |= {f"tx{z}": a * n(f"tx{z}") + b * n(f"ty{z}") + c(f"tx{z}"), f"ty{z}": d * n(f"tx{z}") + e * n(f"ty{z}") + c(f"ty{z}")}
    out |= {"turn": c("turn") + c("sign") * n("turn"), "spin": c("spin") + n("spin"), "sign": c("sign") * n("sign"), "size": c("size") * n("size"), "flip": c("flip") != n("flip")}
    return above.join(low, c("cell_name") == c("n_parent")).select(*keys, c("n_target").alias("cell_name"), *[out[k].alias(k) for k in STATE])


def placements(roots: DataFrame, references: DataFrame, depth: int | None = None) -> DataFrame:
    """Every copy of every cell under the roots (column root) down to depth references (None: all), the roots included.

    references: cell_name, elem_id, target_kind 'cell', target_cell, grid. A cell that comes to stand under itself fails.

    Maps multiply associatively, so the table of ways of exactly n references, joined with itself, gives those of 2n; what
    is placed by fewer than n references and then goes n further makes all that is placed by fewer than 2n. A hierarchy of
    depth d takes log2(d) rounds, and each way is made once, from its first part and its last.
    """
    c, known = F.col, start(roots)
    if depth == 0:
        return known
    levels = deepest(references, roots)
    levels = levels if depth is None else min(depth, levels)
    if not levels:
        return known
    keep = (lambda d, name: staged(d, name)) if levels > PLANNED else (lambda d, name: d)
    ways, n = keep(_step(references), "ways"), 1
    if levels > PLANNED:  # only what lies under the roots is multiplied
        ways = keep(ways.join(_under(roots, references), c("parent") == c("reached"), "left_semi"), "ways")
    while True:
        new = _after(known, ways, c("root"), (c("depth") + n).alias("depth"))
        known = keep(known.unionByName(new.where(c("depth") <= levels)), "placed")
        if 2 * n > levels:
            return known
        longer = _after(ways.withColumnRenamed("target_cell", "cell_name"), ways, c("parent"))
        ways, n = keep(longer.withColumnRenamed("cell_name", "target_cell"), "ways"), 2 * n


def _under(roots: DataFrame, references: DataFrame) -> DataFrame:
    """(reached): the roots and all cells under them."""
    edges, few = _edges(references)
    if few is None:
        under = closure(references).join(roots.select(F.col("root").alias("cell_name")), "cell_name", "left_semi").select("below")
    else:
        begin = roots.join(edges, roots.root == edges.cell_name, "left_semi").select("root").distinct().collect()
        found = _walked([(r.cell_name, r.target_cell) for r in few], [r.root for r in begin])
        under = roots.sparkSession.createDataFrame([(x,) for x in sorted(found)], "below string")
    return roots.select(F.col("root").alias("reached")).union(under).distinct()


def reachable(references: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_name, below): each cell with itself and all cells under it, references to references followed."""
    own = cells.select("cell_name", F.col("cell_name").alias("below"))
    under = closure(with_nested(references)).where(~F.col("below").startswith(NESTED)).select("cell_name", "below")
    return own.union(under.join(cells.select("cell_name"), "cell_name", "left_semi")).distinct()


def apply_points(df: DataFrame) -> Column:
    c = F.col
    return ring.affine(c("points"), c("a"), c("b"), c("c"), c("d"), c("tx"), c("ty"))


def flatten_polygons(placed: DataFrame, polygons: DataFrame, pairs=()) -> DataFrame:
    """Polygons (or paths: width stays) of all placements, filtered by layer before the join."""
    own = polygons.where(filters.on_layers(list(pairs)))
    return placed.join(own, "cell_name").withColumn("points", apply_points(placed)).drop(*STATE)


def flatten_texts(placed: DataFrame, texts: DataFrame, pairs=()) -> DataFrame:
    own = texts.where(filters.text_on_layers(list(pairs)))
    c = F.col
    x, y = c("origin.x"), c("origin.y")
    # Each mirror on the way turns the text's angle over, each rotation adds to it.
    moved = placed.join(own, "cell_name").withColumn("origin", P.point(c("a") * x + c("b") * y + c("tx"), c("c") * x + c("d") * y + c("ty")))
    return moved.withColumn("angle", c("sign") * c("angle") + c("turn")).withColumn("magnification", c("magnification") * c("size")).drop(*STATE)


def residual_references(placed: DataFrame, references: DataFrame, depth: int, on: DataFrame | None = None) -> DataFrame:
    """References that depth leaves standing, each grid carried through the placements over it.

    Mirrors only turn the flag over. on: (elem_id, is_on) of references, to drop those that are off the layers.
    """
    refs = references
    if on is not None and depth > 0:  # what a reference itself targets stays as it is
        good = on.where("is_on").select("elem_id")
        refs = refs.where(~F.col("cell_name").startswith(NESTED)).join(good, "elem_id", "left_semi").unionByName(refs.where(F.col("cell_name").startswith(NESTED)))
    c, g = F.col, F.col("grid")
    moved = placed.where(c("depth") == depth).join(refs, "cell_name")
    apply = lambda p: P.point(c("a0") * p["x"] + c("b0") * p["y"] + c("tx0"), c("c0") * p["x"] + c("d0") * p["y"] + c("ty0"))
    grid = G._with(
        g, origin=apply(g["origin"]), spacing_x=P.multiply(g["spacing_x"], c("size")), spacing_y=P.multiply(g["spacing_y"], c("size")),
        magnification=g["magnification"] * c("size"), angle=G.wrapped(g["angle"] + c("spin")), x_reflection=g["x_reflection"] != c("flip"),
    )
    return without_nested(moved.withColumn("grid", grid).drop(*STATE))


def references_on(references: DataFrame, polygons: DataFrame, paths: DataFrame, texts: DataFrame, pairs) -> DataFrame:
    """(elem_id, is_on) of references (with_nested): whether all that they reach is on the layers."""
    names = references.select(F.col("target_cell").alias("cell_name")).where("cell_name is not null").distinct()
    # Elements that references place directly are members of the cells that the references stand in.
    direct = lambda t, kind: t.drop("cell_name").join(references.where(F.col("target_kind") == kind).select("cell_name", F.col("target_elem_id").alias("elem_id")), "elem_id")
    tables = [t.select(*cols, "cell_name").union(direct(t, kind).select(*cols, "cell_name")) for t, kind, cols in ((polygons, "polygon", ["layer", "data_type"]), (paths, "path", ["layer", "data_type"]), (texts, "text", ["layer"]))]
    under = names.select("cell_name", F.col("cell_name").alias("below")).union(closure(references).select("cell_name", "below"))
    cells = filters.cells_on(names, *tables, under, list(pairs)).withColumnRenamed("cell_name", "target_cell")
    out = references.where("target_kind = 'cell'").join(cells, "target_cell").select("elem_id", "is_on")
    for t, kind, good in ((polygons, "polygon", filters.on_layers(list(pairs))), (paths, "path", filters.on_layers(list(pairs))), (texts, "text", filters.text_on_layers(list(pairs)))):
        own = references.where(F.col("target_kind") == kind).select("elem_id", F.col("target_elem_id").alias("t"))
        out = out.union(own.join(t.select(F.col("elem_id").alias("t"), good.alias("is_on")), "t").select("elem_id", "is_on"))
    return out


def flatten(cells: DataFrame, references: DataFrame, polygons: DataFrame, paths: DataFrame, texts: DataFrame, pairs=(), depth: int | None = None) -> dict[str, DataFrame]:
    """Tables polygons, paths, texts and references of the flattened root cells (column root).

    A root's own elements stay whatever the layers; what references bring is filtered. Depth 0 changes nothing.
    """
    references = with_nested(references)
    placed = placements(cells, references, depth)
    own, rest = placed.where("depth = 0"), placed.where("depth > 0")
    out = {
        "polygons": flatten_polygons(own, polygons).union(flatten_polygons(rest, polygons, pairs)),
        "paths": flatten_polygons(own, paths).union(flatten_polygons(rest, paths, pairs)),
        "texts": flatten_texts(own, texts).union(flatten_texts(rest, texts, pairs)),
    }
    if depth is not None:
        out["references"] = residual_references(placed, references, depth, references_on(references, polygons, paths, texts, pairs) if pairs else None)
    elements = element_references(references, polygons, paths, texts)
    if elements is not None and (depth is None or depth > 0):
        for kind, table in flatten_element_references(placed if depth is None else placed.where(F.col("depth") < depth), references, polygons, paths, texts, pairs).items():
            out[kind] = out[kind].unionByName(table.select(*out[kind].columns))
    return out


def element_references(references: DataFrame, *_tables: DataFrame) -> DataFrame | None:
    """References whose target is an element, if there are any."""
    own = references.where("target_kind in ('polygon', 'path', 'text')")
    return own if own.limit(1).count() else None


def flatten_element_references(placed: DataFrame, references: DataFrame, polygons: DataFrame, paths: DataFrame, texts: DataFrame, pairs=()) -> dict[str, DataFrame]:
    """Copies of elements that references place directly: targets (by elem_id) that are on the layers, grid by grid."""
    out = {}
    for kind, table, flat in (("polygons", polygons, flatten_polygons), ("paths", paths, flatten_polygons), ("texts", texts, flatten_texts)):
        refs = expand(references.where(F.col("target_kind") == kind[:-1])).withColumnRenamed("cell_name", "parent").select("parent", F.col("target_elem_id").alias("t_id"), "column", "row", "grid", "ga", "gb", "gc", "gd", "gb0", "gd0", "gtx", "gty", "gr")
        state = placed.join(refs, placed.cell_name == refs.parent).select("root", "cell_name", (F.col("depth") + 1).alias("depth"), "t_id", *[v.alias(k) for k, v in _compose().items()])
        target = table.drop("cell_name").withColumnRenamed("elem_id", "e_id")
        joined = state.withColumnRenamed("cell_name", "in_cell").withColumn("cell_name", F.col("t_id"))
        keyed = target.withColumn("cell_name", F.col("e_id"))
        moved = flat(joined, keyed, pairs)
        out[kind] = moved.withColumn("elem_id", F.col("e_id")).withColumn("cell_name", F.col("in_cell")).drop("t_id", "e_id", "in_cell")
    return out


def grid_copies(elements: DataFrame, kind: str) -> DataFrame:
    """Copies of one element a row over its own grid (columns grid and the element's): columns outer, rows inner."""
    df = expand(elements)
    c = F.col
    if kind == "text":
        x, y = c("origin.x"), c("origin.y")
        df = df.withColumn("origin", P.point(c("ga") * x + c("gb") * y + c("gtx"), c("gc") * x + c("gd") * y + c("gty")))
        df = df.withColumn("angle", c("gr") * c("angle") + c("grid.angle")).withColumn("magnification", c("magnification") * c("grid.magnification"))
    else:
        df = df.withColumn("points", ring.affine(c("points"), c("ga"), c("gb"), c("gc"), c("gd"), c("gtx"), c("gty")))
    return df.drop("ga", "gb", "gc", "gd", "gb0", "gd0", "gtx", "gty", "gr")


def _one_cell_each(references: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """References and tables in which targets that are elements stand in cells of their own."""
    out = dict(tables)
    for kind, table in tables.items():
        own = references.where(F.col("target_kind") == kind[:-1]).select(F.col("target_elem_id").alias("elem_id")).distinct()
        name = F.concat(F.lit(f"\0{kind} "), F.col("elem_id").cast("string"))
        out[kind] = table.where("cell_name is not null").unionByName(table.join(own, "elem_id", "left_semi").withColumn("cell_name", name).select(*table.columns))
    element = F.col("target_kind").isin("polygon", "path", "text")
    name = F.concat(F.lit("\0"), F.col("target_kind"), F.lit("s "), F.col("target_elem_id").cast("string"))
    return references.withColumn("target_cell", F.when(element, name).otherwise(F.col("target_cell"))).withColumn("target_kind", F.lit("cell")), out


#: What placements that differ by where they are have in common: the map's linear part, and the size of texts.
LINEAR = ("a", "b", "c", "d", "size")


def drawn_boxes(roots: DataFrame, references: DataFrame, polygons: DataFrame, paths: DataFrame, texts: DataFrame) -> DataFrame:
    """(root, cell_name, min_x, min_y, max_x, max_y): the box of what each cell under a root draws there, itself included.

    Placements that only differ by where they are share a row, which has the range of their translations: a box moved about
    fills the box of its extreme places. So rows are pairs of cells times turns and sizes, however often a cell is placed,
    arrays count by their corners, and geometry is touched once a cell, turn and size.
    """
    references, t = _one_cell_each(with_nested(references), {"polygons": polygons, "paths": paths, "texts": texts})
    levels = deepest(references, roots)
    step = expand(references, corners=True).withColumnRenamed("cell_name", "parent")
    c, span = F.col, ("lx", "hx", "ly", "hy")
    level = start(roots).select("root", "cell_name", *LINEAR, *[F.lit(0.0).alias(k) for k in span])
    kept = staged(step.select("parent", "target_cell", "ga", "gb", "gc", "gd", "gtx", "gty", c("grid.magnification").alias("gm")))
    every = level
    for _ in range(levels):
        dx, dy = c("a") * c("gtx") + c("b") * c("gty"), c("c") * c("gtx") + c("d") * c("gty")
        maps = _compose()
        new = level.join(kept, level.cell_name == kept.parent).select(
            "root", c("target_cell").alias("cell_name"), *[maps[k].alias(k) for k in "abcd"], (c("size") * c("gm")).alias("size"), *[(c(k) + (dx if k[1] == "x" else dy)).alias(k) for k in span]
        )
        level = staged(_together(new))
        every = every.union(level)
    every = staged(_together(every))
    shapes = staged(every.select("cell_name", *LINEAR).distinct().withColumn("shape", F.monotonically_increasing_id()))
    own = _own_boxes(shapes, t)
    met = every.join(shapes, ["cell_name", *LINEAR]).join(own, "shape")
    moved = met.select("root", "cell_name", *[(c(f"{m}_{v}") + c(f"{'l' if m == 'min' else 'h'}{v}")).alias(f"{m}_{v}") for m in ("min", "max") for v in "xy"])
    return boxes.union_boxes([moved], ["root", "cell_name"])


def _own_boxes(shapes: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """(shape, box) of what cells have themselves, for each turn and size (shape) that they are drawn in, where they would be
    drawn without being moved."""
    c, zero = F.col, F.lit(0.0)
    turned = lambda d: d.withColumn("points", ring.affine(c("points"), c("a"), c("b"), c("c"), c("d"), zero, zero))
    x, y = c("origin.x"), c("origin.y")
    of = {k: v.join(shapes, "cell_name") for k, v in t.items()}
    of["texts"] = of["texts"].withColumn("origin", P.point(c("a") * x + c("b") * y, c("c") * x + c("d") * y)).withColumn("magnification", c("magnification") * c("size"))
    return boxes.cell_boxes(turned(of["polygons"]), turned(of["paths"]), of["texts"], ["shape"])


def _heights(references: DataFrame) -> tuple[DataFrame, int]:
    """(cell_name, height) of the cells that refer to others: the most references on a way down; and the largest."""
    edges, few = _edges(references)
    if few is None:
        up = staged(closure(references).groupBy("cell_name").agg(F.max("steps").alias("height")), "heights")
        return up, up.agg(F.max("height")).first()[0] or 0
    below = _lists(few)
    found = _depths(below, below)
    rows = [(k, v) for k, v in found.items() if v]
    return references.sparkSession.createDataFrame(rows, "cell_name string, height int"), max(found.values(), default=0)


def cell_boxes(cells: DataFrame, references: DataFrame, polygons: DataFrame, paths: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell_name, min_x, min_y, max_x, max_y) of the cells that draw anything, with what their references draw.

    Which turns and sizes (linear parts of maps) each cell is drawn in is asked from the top downwards, and the box of each
    cell in each of these is made from the bottom upwards, out of its own elements and the boxes of what its references
    place, moved over the range of the copies. So rows are cells by turns and sizes, however many cells stand over them.
    """
    c, span = F.col, ("lx", "hx", "ly", "hy")
    references, t = _one_cell_each(with_nested(references), {"polygons": polygons, "paths": paths, "texts": texts})
    heights, most = _heights(references)
    step = expand(references.where("target_cell is not null"), corners=True).withColumnRenamed("cell_name", "parent")
    kept = staged(step.select("parent", "target_cell", "ga", "gb", "gc", "gd", "gtx", "gty", c("grid.magnification").alias("gm")), "kept")
    one = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0, "size": 1.0}
    asked = level = cells.select("cell_name", *[F.lit(v).alias(k) for k, v in one.items()]).distinct()

    def placed(above: DataFrame, *keys: str) -> DataFrame:
        """What the references of cells in their turns place: the target in its turn, and where."""
        maps = _compose()
        dx, dy = c("a") * c("gtx") + c("b") * c("gty"), c("c") * c("gtx") + c("d") * c("gty")
        new = above.join(kept, above["cell_name"] == kept["parent"]).select(*keys, c("target_cell").alias("cell_name"), *[maps[k].alias(k) for k in "abcd"], (c("size") * c("gm")).alias("size"), dx.alias("dx"), dy.alias("dy"))
        return _rounded(new)

    for _ in range(most):
        level = staged(placed(level).select("cell_name", *LINEAR).distinct(), "asked")
        asked = asked.union(level)
    shapes = staged(asked.distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    done = staged(_own_boxes(shapes, t).select("shape", *boxes.BOX), "boxes")
    if most:
        low = shapes.withColumnRenamed("shape", "low").withColumnRenamed("cell_name", "below")
        edges = placed(shapes, "shape").groupBy("shape", "cell_name", *LINEAR).agg(*[f(v).alias(k) for k, f, v in zip(span, (F.min, F.max) * 2, ("dx", "dx", "dy", "dy"))])
        edges = edges.withColumnRenamed("cell_name", "below").join(low, ["below", *LINEAR]).select("shape", "low", *span)
        edges = staged(edges.join(shapes.join(heights, "cell_name").select("shape", "height"), "shape"), "edges")
    for height in range(1, most + 1):
        lower = done.withColumnRenamed("shape", "low")
        moved = edges.where(c("height") == height).join(lower, "low")
        moved = moved.select("shape", *[(c(f"{m}_{v}") + c(f"{'l' if m == 'min' else 'h'}{v}")).alias(f"{m}_{v}") for m in ("min", "max") for v in "xy"])
        done = staged(boxes.union_boxes([done, moved], ["shape"]), "boxes")
    identity = [(c(k) == v) for k, v in one.items()]
    mine = shapes.join(cells.select("cell_name").distinct(), "cell_name", "left_semi").where(reduce(lambda p, q: p & q, identity))
    return mine.join(done, "shape").select("cell_name", *boxes.BOX)


def _rounded(placed: DataFrame) -> DataFrame:
    """The linear part to twelve digits of the size, so that ways that turn alike are told to be so."""
    size, c = F.col("size"), F.col
    order = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(size))))
    placed = placed.withColumn("rounded", F.when(size == 0, F.lit(0.0)).otherwise(F.round(size / order, 12) * order))
    placed = placed.withColumns({k: F.when(size == 0, F.lit(0.0)).otherwise((F.round(c(k) / size, 12) + F.lit(0.0)) * c("rounded")) for k in "abcd"})
    return placed.withColumn("size", c("rounded")).drop("rounded")


def _together(placed: DataFrame) -> DataFrame:
    """One row a root, cell and linear part, with the range of the translations."""
    return _rounded(placed).groupBy("root", "cell_name", *LINEAR).agg(F.min("lx").alias("lx"), F.max("hx").alias("hx"), F.min("ly").alias("ly"), F.max("hy").alias("hy"))
