"""Expressions on points (struct<x, y>). All are columns in, column out; angles are degrees, counter-clockwise."""

from __future__ import annotations

import math
from decimal import Decimal
from numbers import Real

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EPSILON = 1e-4
FLOAT_EPSILON = 2.220446049250313e-16


def num(v) -> Column:
    return F.lit(float(v)) if isinstance(v, Real) else v


def point(x, y) -> Column:
    """A point of two numbers or columns."""
    return F.struct(num(x).cast("double").alias("x"), num(y).cast("double").alias("y"))


def as_point(p) -> Column:
    """A column as it is; anything with two numbers at 0 and 1 as a literal point."""
    if isinstance(p, Column):
        return p
    try:
        return point(float(p[0]), float(p[1]))
    except (TypeError, IndexError, KeyError, ValueError):
        raise TypeError("Invalid point format: expected two numbers") from None


def item(p: Column, i: int) -> Column:
    if i not in (0, 1):
        raise IndexError("a point has the items 0 and 1")
    return p["x"] if i == 0 else p["y"]


def items(p: Column) -> tuple[Column, Column]:
    """Both coordinates, to unpack."""
    return p["x"], p["y"]


def distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - p["y"] * q["x"]


def add(p: Column, q: Column) -> Column:
    return point(p["x"] + q["x"], p["y"] + q["y"])


def subtract(p: Column, q: Column) -> Column:
    return point(p["x"] - q["x"], p["y"] - q["y"])


def multiply(p: Column, f) -> Column:
    return point(p["x"] * num(f), p["y"] * num(f))


def divide(p: Column, f) -> Column:
    """Quotient; a zero divisor fails under ANSI rules."""
    return point(p["x"] / num(f), p["y"] / num(f))


def floor_divide(p: Column, f) -> Column:
    return point(F.floor(p["x"] / num(f)), F.floor(p["y"] / num(f)))


def negate(p: Column) -> Column:
    return point(-p["x"], -p["y"])


def truth(p: Column) -> Column:
    return (p["x"] != 0) | (p["y"] != 0)


def sin_cos(angle) -> tuple[Column, Column]:
    """Sine and cosine of degrees; folded to literals where the angle is a number."""
    if isinstance(angle, Real):
        r = math.radians(angle)
        return F.lit(math.sin(r)), F.lit(math.cos(r))
    r = F.radians(angle)
    return F.sin(r), F.cos(r)


def rotate(p: Column, angle, centre=(0, 0)) -> Column:
    c, (s, k) = as_point(centre), sin_cos(angle)
    dx, dy = p["x"] - c["x"], p["y"] - c["y"]
    return point(c["x"] + dx * k - dy * s, c["y"] + dx * s + dy * k)


def scale(p: Column, factor, centre=(0, 0)) -> Column:
    c = as_point(centre)
    return point((p["x"] - c["x"]) * num(factor) + c["x"], (p["y"] - c["y"]) * num(factor) + c["y"])


def reflect(p: Column, angle, centre=(0, 0)) -> Column:
    """Mirror image across the line through centre at an angle."""
    c, (s, k) = as_point(centre), sin_cos(angle)
    dx, dy = p["x"] - c["x"], p["y"] - c["y"]
    two, twice = k * k - s * s, k * s * 2.0
    return point(c["x"] + (dx * two + dy * twice), c["y"] + (dx * twice - dy * two))


def round_value(v: Column, digits: int = 0) -> Column:
    """Half away from zero at a decimal place, by scaling."""
    f = 10.0**digits
    return F.round(v * f) / f


def round_point(p: Column, digits: int = 0) -> Column:
    return point(round_value(p["x"], digits), round_value(p["y"], digits))


def angle_to(p: Column, q: Column) -> Column:
    """Direction from p to q in [0, 360); null for equal points."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    a = F.degrees(F.atan2(dy, dx))
    return F.when((dx == 0) & (dy == 0), None).when(a < 0, a + 360.0).otherwise(a)


def is_close(p: Column, q: Column, rel_tol: float = 1e-6, abs_tol: float = 1e-10) -> Column:
    near = lambda a, b: F.abs(a - b) <= abs_tol + rel_tol * F.abs(b)
    return near(p["x"], q["x"]) & near(p["y"], q["y"])


def epsilon_close_value(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return round_value(F.abs(a - b), 10) < epsilon


def epsilon_is_close(p: Column, q: Column, epsilon: float = EPSILON) -> Column:
    return epsilon_close_value(p["x"], q["x"], epsilon) & epsilon_close_value(p["y"], q["y"], epsilon)


def point_hash(p: Column) -> Column:
    return F.xxhash64(p["x"], p["y"])


def _plain(v: float) -> str:
    if v != v:
        return "NaN"
    text = repr(v)
    text = format(Decimal(text), "f") if "e" in text else text
    return text[:-2] if text.endswith(".0") else text


def _debug(v: float) -> str:
    if v != v or math.isinf(v):
        return _plain(v)
    if v != 0 and not 1e-5 <= abs(v) < 1e16:
        digits, _, power = f"{Decimal(repr(v)).normalize():e}".partition("e")
        return f"{digits}e{int(power)}"
    text = _plain(v)
    return text if "." in text else f"{text}.0"


def _plain_texts(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _plain(x) for x in v.to_pylist()], pa.string())


def _debug_texts(v: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _debug(x) for x in v.to_pylist()], pa.string())


def number_text(v: Column) -> Column:
    """A double as its shortest decimal text: whole numbers without a decimal point, none with an exponent. Python finds
    the digits: a cast to string has more of them than needed (1.9999999999999998E22 for 2e22) before Java 19."""
    return F.arrow_udf(_plain_texts, StringType())(v.cast("double"))


def debug_number(v: Column) -> Column:
    """A double as text that keeps .0 on whole numbers and has an exponent where it is very small or very large."""
    return F.arrow_udf(_debug_texts, StringType())(v.cast("double"))


def to_text(p: Column) -> Column:
    return F.concat(F.lit("Point("), number_text(p["x"]), F.lit(", "), number_text(p["y"]), F.lit(")"))


def to_repr(p: Column) -> Column:
    return F.concat(F.lit("("), number_text(p["x"]), F.lit(", "), number_text(p["y"]), F.lit(")"))
