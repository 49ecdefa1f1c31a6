"""Expressions on paths: open point lists with an optional end type and width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from . import point as P
from . import ring


def checked(points) -> Column:
    """The points; fails for fewer than two."""
    points = ring.as_points(points)
    return F.when(F.size(points) >= 2, points).otherwise(F.raise_error(F.lit("Path must have at least 2 points")))


length = ring.length
move_to, move_by, rotate, scale, reflect = ring.move_to, ring.move_by, ring.rotate, ring.scale, ring.reflect


def _box(x0, x1, y0, y1, dx, dy) -> Column:
    """Box of two points, wider by the size of dy in x and of dx in y."""
    return F.struct(
        (F.least(x0, x1) - F.abs(dy)).alias("x0"), (F.greatest(x0, x1) + F.abs(dy)).alias("x1"), (F.least(y0, y1) - F.abs(dx)).alias("y0"), (F.greatest(y0, y1) + F.abs(dx)).alias("y1")
    )


def bounds(points: Column, width: Column) -> dict[str, Column]:
    """Box of the drawn path: both ends go on by half the width, and every point reaches half the width to both sides of
    each segment that meets it. Segments of no length count for nothing; if all are such, the box is null."""
    w = F.coalesce(width, F.lit(0.0)) / 2.0
    n = F.size(points)
    pairs = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), P.distance(a, b).alias("d")))

    def drawn(s: Column, i: Column) -> Column:
        dx, dy = w * (s["b"]["x"] - s["a"]["x"]) / s["d"], w * (s["b"]["y"] - s["a"]["y"]) / s["d"]
        # The first segment begins, and the last one ends, half the width further out.
        out = F.when(i == 0, 1.0).otherwise(0.0), F.when(i == n - 2, 1.0).otherwise(0.0)
        box = _box(s["a"]["x"] - out[0] * dx, s["b"]["x"] + out[1] * dx, s["a"]["y"] - out[0] * dy, s["b"]["y"] + out[1] * dy, dx, dy)
        return F.when(s["d"] > 0, box)

    segments = F.filter(F.transform(pairs, drawn), lambda s: s.isNotNull())
    pick = lambda k: F.transform(segments, lambda s: s[k])
    return {"min_x": F.array_min(pick("x0")), "min_y": F.array_min(pick("y0")), "max_x": F.array_max(pick("x1")), "max_y": F.array_max(pick("y1"))}


def type_name(path_type: Column) -> Column:
    """Name of the end type; fails for a number that is none."""
    out = F.when(path_type.isNull(), None)
    for k, name in schema.PATH_TYPES.items():
        out = out.when(path_type == k, name)
    return out.otherwise(F.raise_error(F.lit("Invalid path type")))


def epsilon_equal(a: dict[str, Column], b: dict[str, Column], epsilon: float = P.EPSILON) -> Column:
    """Equal rows of points, layer, data_type, path_type and width."""
    same = ring.epsilon_equal(a["points"], b["points"], epsilon)
    for c in ("layer", "data_type", "path_type", "width"):
        same = same & a[c].eqNullSafe(b[c])
    return same


def to_text(points: Column, layer: Column, data_type: Column, path_type: Column, width: Column) -> Column:
    return F.concat(
        F.lit("Path with "), F.size(points).cast("string"), F.lit(" points on layer "), layer.cast("string"), F.lit(" with data type "), data_type.cast("string"),
        F.lit(", "), type_name(F.coalesce(path_type, F.lit(0))), F.lit(" and width "), P.number_text(F.coalesce(width, F.lit(0.0))),
    )


def to_repr(points: Column, layer: Column, data_type: Column, path_type: Column, width: Column) -> Column:
    first, last = P.to_repr(F.element_at(points, 1)), P.to_repr(F.element_at(points, -1))
    n = F.size(points)
    ends = F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(", "), last)).otherwise(F.concat(first, F.lit(", ..., "), last))
    rest = [layer.cast("string"), data_type.cast("string"), type_name(F.coalesce(path_type, F.lit(0))), P.number_text(F.coalesce(width, F.lit(0.0)))]
    return F.concat(F.lit("Path(["), F.coalesce(F.when(n > 0, ends), F.lit("")), F.lit("], "), F.concat_ws(", ", *rest), F.lit(")"))
