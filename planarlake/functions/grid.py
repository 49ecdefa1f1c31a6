"""Expressions on placement grids: struct<origin, columns, rows, spacing_x, spacing_y, magnification, angle, x_reflection>."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import point as P

FIELDS = ("origin", "columns", "rows", "spacing_x", "spacing_y", "magnification", "angle", "x_reflection")
#: Decimals to which the places of copies are rounded.
PLACE_DIGITS = 10


def grid(origin=(0, 0), columns=1, rows=1, spacing_x=(0, 0), spacing_y=(0, 0), magnification=1.0, angle=0.0, x_reflection=False) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        P.as_point(origin).alias("origin"), col(columns).cast("long").alias("columns"), col(rows).cast("long").alias("rows"), P.as_point(spacing_x).alias("spacing_x"),
        P.as_point(spacing_y).alias("spacing_y"), P.num(magnification).cast("double").alias("magnification"), P.num(angle).cast("double").alias("angle"), col(x_reflection).alias("x_reflection"),
    )


def bound(f):
    """The function with its grid bound to a variable: chains of operations stay as long as the chain, instead of
    repeating the inner grids in every field."""

    @wraps(f)
    def once(g: Column, *args, **named) -> Column:
        return F.transform(F.array(g), lambda v: f(v, *args, **named))[0]

    return once


def _with(g: Column, **new: Column) -> Column:
    return F.struct(*[new.get(f, g[f]).alias(f) for f in FIELDS])


def move_to(g: Column, target) -> Column:
    return _with(g, origin=P.as_point(target))


@bound
def move_by(g: Column, v) -> Column:
    return _with(g, origin=P.add(g["origin"], P.as_point(v)))


def wrapped(angle: Column) -> Column:
    r = angle % 360.0
    return F.when(r < 0, r + 360.0).otherwise(r)


@bound
def rotate(g: Column, angle, centre=(0, 0)) -> Column:
    """Origin turned; the angle stays in [0, 360); spacings stay."""
    return _with(g, origin=P.rotate(g["origin"], angle, centre), angle=wrapped(g["angle"] + P.num(angle)))


@bound
def scale(g: Column, factor, centre=(0, 0)) -> Column:
    """Origin and spacings scaled as points about the centre."""
    return _with(
        g, origin=P.scale(g["origin"], factor, centre), spacing_x=P.scale(g["spacing_x"], factor, centre), spacing_y=P.scale(g["spacing_y"], factor, centre),
        magnification=g["magnification"] * P.num(factor),
    )


@bound
def reflect(g: Column, angle, centre=(0, 0)) -> Column:
    """Across the x axis only the mirror flag turns over; across other lines origin, spacings and angle are mirrored."""
    c = P.as_point(centre)
    a = P.num(angle)
    axis = (a == 0) & (c["y"] == 0)
    plain = _with(g, x_reflection=~g["x_reflection"])
    other = _with(
        g, origin=P.reflect(g["origin"], angle, c), spacing_x=P.reflect(g["spacing_x"], angle, c), spacing_y=P.reflect(g["spacing_y"], angle, c),
        angle=(g["angle"] + 2.0 * (a - g["angle"])) % 360.0,
    )
    return F.when(axis, plain).otherwise(other)


def equal(a: Column, b: Column, epsilon: float = P.EPSILON) -> Column:
    same = P.epsilon_is_close(a["origin"], b["origin"], epsilon) & P.epsilon_is_close(a["spacing_x"], b["spacing_x"], epsilon) & P.epsilon_is_close(a["spacing_y"], b["spacing_y"], epsilon)
    for f in ("columns", "rows", "magnification", "angle", "x_reflection"):
        same = same & (a[f] == b[f])
    return same


def place(g: Column, column: Column, row: Column) -> Column:
    """Where the copy in a column and row of the grid goes."""
    o = g["origin"]
    at = P.point(o["x"] + g["spacing_x"]["x"] * column + g["spacing_y"]["x"] * row, o["y"] + g["spacing_x"]["y"] * column + g["spacing_y"]["y"] * row)
    return P.round_point(P.rotate(at, g["angle"], o), PLACE_DIGITS)


def to_text(g: Column) -> Column:
    pt = P.to_repr
    return F.concat(
        F.lit("Grid at "), pt(g["origin"]), F.lit(" with "), g["columns"].cast("string"), F.lit(" columns and "), g["rows"].cast("string"), F.lit(" rows, spacing ("), pt(g["spacing_x"]),
        F.lit(", "), pt(g["spacing_y"]), F.lit("), magnification "), debug_number(g["magnification"]), F.lit(", angle "), debug_number(g["angle"]), F.lit(", x_reflection "), g["x_reflection"].cast("string"),
    )


debug_number = P.debug_number


def to_repr(g: Column) -> Column:
    pt = P.to_repr
    parts = [pt(g["origin"]), g["columns"].cast("string"), g["rows"].cast("string"), pt(g["spacing_x"]), pt(g["spacing_y"]), debug_number(g["magnification"]), debug_number(g["angle"]), g["x_reflection"].cast("string")]
    return F.concat(F.lit("Grid("), F.concat_ws(", ", *parts), F.lit(")"))
