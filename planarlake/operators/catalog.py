"""Cells and libraries as tables: adding, removing, membership, emptiness, equality and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import path as H
from ..functions import point as P
from ..functions import ring
from ..functions import text as X

KINDS = ("polygons", "paths", "references", "texts")
#: What must be equal as it is of each kind, beside what is close by epsilon.
EXACT = {
    "polygons": ("layer", "data_type"),
    "paths": ("layer", "data_type", "path_type", "width"),
    "texts": ("text", "layer", "magnification", "angle", "x_reflection", "vertical_presentation", "horizontal_presentation"),
    "references": ("target_kind", "target_cell", "target_elem_id"),
}
#: The column that is close by epsilon, as a whole.
CLOSE = {"polygons": "points", "paths": "points", "texts": "origin", "references": "grid"}


def anchor(kind: str, c: Column) -> Column:
    """A point that is close where elements are equal."""
    return F.element_at(c, 1) if CLOSE[kind] == "points" else c if CLOSE[kind] == "origin" else c["origin"]


def close(kind: str, a: Column, b: Column, epsilon: float) -> Column:
    same = {"points": ring.epsilon_equal, "origin": P.epsilon_is_close, "grid": G.equal}[CLOSE[kind]]
    return same(a, b, epsilon)


def add_elements(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new)


def add_cells(cells: DataFrame, new: DataFrame, replace: bool = False, key: str = "cell_name") -> DataFrame:
    """Cells with new ones added. A name that is there already, or that new itself repeats, fails; or the last one counts
    (by cell_seq, where there is one)."""
    if replace:
        row = F.struct(*new.columns)
        last = F.max_by(row, "cell_seq") if "cell_seq" in new.columns else F.max(row)
        one = new.groupBy(F.col(key).alias("added")).agg(last.alias("last")).select("last.*")
        return cells.join(new, key, "left_anti").unionByName(one)
    names = new.groupBy(key).count()
    clash = names.join(cells.select(key), key, "left_semi").unionByName(names.where("count > 1")).limit(1).collect()
    if clash:
        raise ValueError(f"Cell with name {clash[0][key]} already exists in library")
    return cells.unionByName(new)


def remove_cells(cells: DataFrame, names: DataFrame, key: str = "cell_name") -> DataFrame:
    """Cells without those named; names that aren't there do nothing."""
    return cells.join(names.select(key), key, "left_anti")


def _bucket(v: Column, epsilon: float) -> Column:
    return F.floor(v / epsilon).cast("long")


def near(left: DataFrame, right: DataFrame, epsilon: float, keys: list[str], how: str, kind: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows of left for which a row of right is equal by epsilon (how: a kind of join; an inner one brings the kept columns
    of right, as r_). Closeness isn't transitive and so no join key: right goes to its anchor's bucket and the neighbours,
    left to its own, and the predicate decides."""
    col = CLOSE[kind]
    at = anchor(kind, F.col(col))
    mine = left.withColumn("bx", _bucket(at["x"], epsilon)).withColumn("by", _bucket(at["y"], epsilon))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    other = right.select(*[F.col(k).alias(f"r_{k}") for k in (*keys, *kept)], F.col(col).alias("r_close")).dropDuplicates()
    at = anchor(kind, F.col("r_close"))
    other = other.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    other = other.withColumn("r_bx", _bucket(at["x"], epsilon) + F.col("dx")).withColumn("r_by", _bucket(at["y"], epsilon) + F.col("dy"))
    on = (F.col("bx") == F.col("r_bx")) & (F.col("by") == F.col("r_by")) & close(kind, F.col(col), F.col("r_close"), epsilon)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return mine.join(other, on, how).drop("bx", "by")


def contains_elements(members: DataFrame, wanted: DataFrame, keys: list[str] | None = None, epsilon: float = P.EPSILON, kind: str = "polygons") -> DataFrame:
    """Rows of wanted that stand among members; equal are those of one cell whose keys are the same (by default all of the
    kind's own) and that are close."""
    return near(wanted, members, epsilon, ["cell_name", *EXACT[kind]] if keys is None else keys, "left_semi", kind)


def remove_elements(members: DataFrame, gone: DataFrame, keys: list[str] | None = None, epsilon: float = P.EPSILON, kind: str = "polygons") -> DataFrame:
    """Members without those equal to a row of gone, as in contains_elements."""
    return near(members, gone, epsilon, ["cell_name", *EXACT[kind]] if keys is None else keys, "left_anti", kind)


def counts(cells: DataFrame, polygons: DataFrame, paths: DataFrame, references: DataFrame, texts: DataFrame) -> DataFrame:
    """cell_name with the number of its polygons, paths, references and texts."""
    every = reduce(DataFrame.unionByName, [t.select("cell_name", F.lit(k).alias("kind")) for k, t in zip(KINDS, (polygons, paths, references, texts))])
    per = every.groupBy("cell_name").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    return cells.select("cell_name").join(per, "cell_name", "left").fillna(0)


def empty_cells(cells: DataFrame, *tables: DataFrame) -> DataFrame:
    out = cells.select("cell_name")
    for t in tables:
        out = out.join(t.select("cell_name"), "cell_name", "left_anti")
    return out


def cell_text(counted: DataFrame) -> DataFrame:
    return counted.withColumn("shown", F.format_string("Cell: %s with %d polygons, %d paths, %d references, and %d texts", "cell_name", *[f"n_{k}" for k in KINDS]))


def shown(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(cell_name, elem_id, text, repr) of the elements of each kind, and (cell_name, text, repr) of the cells."""
    c, key = F.col, ["cell_name", "elem_id"]
    columns = lambda names: {k: c(k) for k in names}
    text_cols = columns((*EXACT["texts"], "origin"))
    out = {
        "polygons": t["polygons"].select(*key, ring.polygon_text(c("points"), c("layer"), c("data_type")).alias("text"), ring.polygon_repr(c("points"), c("layer"), c("data_type")).alias("repr")),
        "paths": t["paths"].select(*key, *[f(*[c(k) for k in ("points", "layer", "data_type", "path_type", "width")]).alias(n) for f, n in ((H.to_text, "text"), (H.to_repr, "repr"))]),
        "texts": t["texts"].select(*key, X.to_repr(text_cols).alias("repr"), X.to_text(text_cols).alias("text")).select(*key, "text", "repr"),
    }
    cells = cell_text(counts(*[t[k] for k in ("cells", "polygons", "paths", "references", "texts")]))
    out["cells"] = cells.select("cell_name", c("shown").alias("text"), F.concat(F.lit("Cell("), c("cell_name"), F.lit(")")).alias("repr"))
    # What references target, by kind and key; those to references level by level.
    targets = [out[k].select(F.lit(k[:-1]).alias("target_kind"), F.lit(None).cast("string").alias("target_cell"), c("elem_id").alias("target_elem_id"), c("text").alias("t"), c("repr").alias("r")) for k in ("polygons", "paths", "texts")]
    known = reduce(DataFrame.union, targets).union(out["cells"].select(F.lit("cell"), "cell_name", F.lit(None).cast("long"), "text", "repr"))
    refs, parts = t["references"], []
    done = refs.limit(0).select("elem_id")
    while True:
        on = (refs["target_kind"] == known["target_kind"]) & refs["target_cell"].eqNullSafe(known["target_cell"]) & refs["target_elem_id"].eqNullSafe(known["target_elem_id"])
        new = refs.join(known, on).select(refs["cell_name"], refs["elem_id"], F.concat(F.lit("Reference of "), c("t"), F.lit(" with "), G.to_text(refs["grid"])).alias("text"), F.concat(F.lit("Reference("), c("r"), F.lit(")")).alias("repr"))
        parts.append(new)
        done = done.union(new.select("elem_id"))
        refs_left = t["references"].where("target_kind = 'reference'").join(done, "elem_id", "left_anti")
        if len(parts) > 1 and not new.limit(1).count() or not refs_left.limit(1).count():
            break
        known, refs = new.select(F.lit("reference").alias("target_kind"), F.lit(None).cast("string").alias("target_cell"), c("elem_id").alias("target_elem_id"), c("text").alias("t"), c("repr").alias("r")), refs_left
    out["references"] = reduce(DataFrame.union, parts)
    return out
