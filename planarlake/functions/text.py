"""Expressions on text labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from . import point as P


def bounds(text: Column, origin: Column, magnification: Column) -> dict[str, Column]:
    """A box of bytes x magnification by magnification around the origin, whatever the angle and presentation."""
    w, h = F.octet_length(text) * magnification / 2.0, magnification / 2.0
    return {"min_x": origin["x"] - w, "min_y": origin["y"] - h, "max_x": origin["x"] + w, "max_y": origin["y"] + h}


def move_to(t: dict[str, Column], target) -> dict[str, Column]:
    return t | {"origin": P.as_point(target)}


def move_by(t: dict[str, Column], v) -> dict[str, Column]:
    return t | {"origin": P.add(t["origin"], P.as_point(v))}


def rotate(t: dict[str, Column], angle, centre=(0, 0)) -> dict[str, Column]:
    """Origin turned, angle added without wrapping."""
    return t | {"origin": P.rotate(t["origin"], angle, centre), "angle": t["angle"] + P.num(angle)}


def scale(t: dict[str, Column], factor, centre=(0, 0)) -> dict[str, Column]:
    return t | {"origin": P.scale(t["origin"], factor, centre), "magnification": t["magnification"] * P.num(factor)}


def reflect(t: dict[str, Column], angle, centre=(0, 0)) -> dict[str, Column]:
    """Origin mirrored; the angle becomes twice the line's less its own; the mirror flag stays."""
    return t | {"origin": P.reflect(t["origin"], angle, centre), "angle": (t["angle"] + 2.0 * (P.num(angle) - t["angle"])) % 360.0}


def _name(v: Column, names: dict[int, str], what: str) -> Column:
    out = F.when(v.isNull(), None)
    for k, n in names.items():
        out = out.when(v == k, n)
    return out.otherwise(F.raise_error(F.lit(f"Invalid {what} presentation")))


def vertical_name(v: Column) -> Column:
    return _name(v, schema.VERTICAL, "vertical")


def horizontal_name(v: Column) -> Column:
    return _name(v, schema.HORIZONTAL, "horizontal")


def presentation_code(vertical: Column, horizontal: Column) -> Column:
    """Both presentations in the file's one number."""
    return vertical * 4 + horizontal


def presentations(code: Column) -> Column:
    """struct<vertical, horizontal> of the file's number; fails for others, font bits included."""
    v, h = F.floor(code / 4).cast("int"), (code % 4).cast("int")
    good = (code >= 0) & (v <= 2) & (h <= 2)
    return F.when(good, F.struct(v.alias("vertical"), h.alias("horizontal"))).otherwise(F.raise_error(F.lit("Invalid presentation value")))


def equal(a: dict[str, Column], b: dict[str, Column], epsilon: float = P.EPSILON) -> Column:
    same = P.epsilon_is_close(a["origin"], b["origin"], epsilon)
    for c in ("text", "layer", "magnification", "angle", "x_reflection", "vertical_presentation", "horizontal_presentation"):
        same = same & (a[c] == b[c])
    return same


def to_text(t: dict[str, Column]) -> Column:
    return F.concat(
        F.lit("Text '"), t["text"], F.lit("' vertical: "), vertical_name(t["vertical_presentation"]), F.lit(", horizontal: "),
        horizontal_name(t["horizontal_presentation"]), F.lit(" at "), P.to_repr(t["origin"]),
    )


def to_repr(t: dict[str, Column]) -> Column:
    parts = [
        t["text"], P.to_repr(t["origin"]), t["layer"].cast("string"), P.number_text(t["magnification"]), P.number_text(t["angle"]), t["x_reflection"].cast("string"),
        vertical_name(t["vertical_presentation"]), horizontal_name(t["horizontal_presentation"]),
    ]
    return F.concat(F.lit("Text("), F.concat_ws(", ", *parts), F.lit(")"))
