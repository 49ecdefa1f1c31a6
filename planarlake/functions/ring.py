"""Expressions on point arrays: polygons' rings and measures shared with paths.

Folds over the array keep the order of summation, so measures are the same on every run and engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import point as P

MAX_POINTS = 8191


def as_points(points) -> Column:
    if isinstance(points, Column):
        return points
    if isinstance(points, (str, bytes)) or not hasattr(points, "__iter__"):
        raise TypeError("Points must be a sequence of points")
    made = [P.as_point(p) for p in points]
    if not made:
        raise TypeError("Points cannot be empty")
    return F.array(*made)


def checked_layer(layer: Column) -> Column:
    """The layer itself; fails outside 0 to 255."""
    layer = layer if isinstance(layer, Column) else F.lit(layer)
    return F.when((layer >= 0) & (layer <= 255), layer).otherwise(F.raise_error(F.lit("Layer must be in the range 0-255")).cast("int"))


def closed(points: Column) -> Column:
    """The ring with its first point appended unless it ends there."""
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    same = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.when(same, points).otherwise(F.concat(points, F.array(first)))


def _fold(points: Column, term, pairs: Column) -> Column:
    """Sum of term(points[i - 1], points[i]) over the positions in pairs, in order."""
    return F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + term(i))


def bounds(points: Column) -> dict[str, Column]:
    """Smallest and largest coordinates; NaN doesn't count, no point gives nulls."""
    xs = F.filter(F.transform(points, lambda p: p["x"]), lambda v: ~F.isnan(v))
    ys = F.filter(F.transform(points, lambda p: p["y"]), lambda v: ~F.isnan(v))
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def area(points: Column) -> Column:
    """Unsigned shoelace area; the last point is joined to the first."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: P.cross(p, F.element_at(points, F.when(i + 2 > n, 1).otherwise(i + 2))))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2.0


def length(points: Column) -> Column:
    """Sum of the distances of neighbours, first to last: perimeter of a closed ring, length of a path."""
    steps = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: P.distance(F.element_at(points, i + 1), p))
    return F.aggregate(steps, F.lit(0.0), lambda a, v: a + v)


def on_segment(px, py, a: Column, b: Column) -> Column:
    inside = (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"])) & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"]))
    return inside & (F.abs((py - a["y"]) * (b["x"] - a["x"]) - (px - a["x"]) * (b["y"] - a["y"])) <= P.FLOAT_EPSILON)


def crosses(px, py, a: Column, b: Column) -> Column:
    """Whether a ray to the right of the point crosses the edge; CASE keeps the division from level edges."""
    at = (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
    return F.when((a["y"] > py) != (b["y"] > py), px < at).otherwise(False)


def _before(points: Column, i: Column) -> Column:
    return F.element_at(points, F.when(i == 0, F.size(points)).otherwise(i))


def edges(points: Column) -> Column:
    """Array of the ring's edges, (a, b) each, beginning with the one from the last point to the first."""
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.size(points) - 1))
    return F.zip_with(before, points, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_edge(points: Column, p: Column) -> Column:
    at = F.transform(points, lambda q, i: on_segment(p["x"], p["y"], _before(points, i), q))
    return F.exists(at, lambda v: v)


def contains(points: Column, p: Column) -> Column:
    """On the edge, or inside by an odd number of crossings: one fold over the edges that keeps the point before."""
    x, y = p["x"], p["y"]
    start = F.struct(F.element_at(points, -1).alias("q"), F.lit(False).alias("odd"), F.lit(False).alias("edge"))

    def step(acc: Column, q: Column) -> Column:
        return F.struct(q.alias("q"), (acc["odd"] != crosses(x, y, q, acc["q"])).alias("odd"), (acc["edge"] | on_segment(x, y, acc["q"], q)).alias("edge"))

    return F.aggregate(points, start, step, lambda acc: acc["edge"] | acc["odd"])


def all_of(test, points: Column, probes) -> Column:
    out = F.lit(True)
    for p in probes:
        out = out & test(points, P.as_point(p))
    return out


def any_of(test, points: Column, probes) -> Column:
    out = F.lit(False)
    for p in probes:
        out = out | test(points, P.as_point(p))
    return out


def intersects(a: Column, b: Column) -> Column:
    """Whether a vertex of one lies in or on the other (crossings without such a vertex don't count)."""
    return F.exists(a, lambda p: contains(b, p)) | F.exists(b, lambda p: contains(a, p))


def move_by(points: Column, v) -> Column:
    v = P.as_point(v)
    return F.transform(points, lambda p: P.add(p, v))


def move_to(points: Column, target) -> Column:
    """Moved so that the first vertex lands on target."""
    t = P.as_point(target)
    return F.transform(points, lambda p: P.add(p, P.subtract(t, F.element_at(points, 1))))


def rotate(points: Column, angle, centre=(0, 0)) -> Column:
    return F.transform(points, lambda p: P.rotate(p, angle, centre))


def scale(points: Column, factor, centre=(0, 0)) -> Column:
    return F.transform(points, lambda p: P.scale(p, factor, centre))


def reflect(points: Column, angle, centre=(0, 0)) -> Column:
    return F.transform(points, lambda p: P.reflect(p, angle, centre))


def affine(points: Column, a: Column, b: Column, c: Column, d: Column, tx: Column, ty: Column) -> Column:
    return F.transform(points, lambda p: P.point(a * p["x"] + b * p["y"] + tx, c * p["x"] + d * p["y"] + ty))


def regular(centre, radius, n_sides: Column | int, rotation=0.0) -> Column:
    """Closed regular polygon, n_sides + 1 points."""
    c, n = P.as_point(centre), F.lit(n_sides) if isinstance(n_sides, int) else n_sides
    if isinstance(n_sides, int) and n_sides < 1:
        raise ValueError("a polygon has a side at least")
    at = lambda i: 2.0 * math.pi * i / n + F.radians(P.num(rotation))
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: P.point(c["x"] + P.num(radius) * F.cos(at(i)), c["y"] + P.num(radius) * F.sin(at(i))))
    return F.concat(ring, F.slice(ring, 1, 1))


def ellipse(centre, horizontal_radius, vertical_radius=None, initial_angle=0.0, final_angle=360.0, n_sides: Column | int = 400) -> Column:
    """n_sides points along the arc and the centre as the last one."""
    c, n = P.as_point(centre), F.lit(n_sides) if isinstance(n_sides, int) else n_sides
    h = P.num(horizontal_radius)
    v = h if vertical_radius is None else P.num(vertical_radius)
    start = F.radians(P.num(initial_angle))
    step = (F.radians(P.num(final_angle)) - start) / n
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: P.point(c["x"] + h * F.cos(start + i * step), c["y"] + v * F.sin(start + i * step)))
    return F.concat(ring, F.array(c))


def epsilon_equal(a: Column, b: Column, epsilon: float = P.EPSILON) -> Column:
    """Same number of points, close position by position."""
    near = F.forall(F.zip_with(a, b, lambda p, q: F.coalesce(P.epsilon_is_close(p, q, epsilon), F.lit(False))), lambda v: v)
    return (F.size(a) == F.size(b)) & near


def polygon_text(points: Column, layer: Column, data_type: Column) -> Column:
    return F.concat(
        F.lit("Polygon with "), F.size(points).cast("string"), F.lit(" point(s), starting at "), P.to_repr(F.element_at(points, 1)),
        F.lit(" on layer "), layer.cast("string"), F.lit(", data type "), data_type.cast("string"),
    )


def polygon_repr(points: Column, layer: Column, data_type: Column) -> Column:
    return F.concat(
        F.lit("Polygon(["), P.to_repr(F.element_at(points, 1)), F.lit(", ..., "), P.to_repr(F.element_at(points, -1)), F.lit("], "), layer.cast("string"), F.lit(", "), data_type.cast("string"), F.lit(")")
    )
