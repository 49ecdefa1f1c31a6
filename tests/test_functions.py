"""Examples for the expressions: inputs with their expected values."""

import math
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from planarlake.functions import grid as G
from planarlake.functions import path as H
from planarlake.functions import point as P
from planarlake.functions import ring as R
from planarlake.functions import text as X

SQUARE = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
HOUSE = [(0, 0), (4, 0), (5, 2), (2, 4), (-1, 3)]


@pytest.fixture()
def value(spark):
    def get(col):
        v = spark.range(1).select(col.alias("v")).first().v
        return tuple(v) if hasattr(v, "asDict") else v

    return get


def pts(v):
    return [tuple(p) for p in v]


def near(a, b, tol=1e-9):
    return all(abs(x - y) < tol for p, q in zip(a, b) for x, y in zip(p, q)) and len(a) == len(b)


def test_points(value):
    p, q = P.point(3, 4), P.point(0, 0)
    assert value(P.distance(p, q)) == 5
    assert value(P.cross(p, P.point(2, 1))) == -5
    assert value(P.add(p, P.point(1, 1))) == (4, 5) and value(P.subtract(p, P.point(1, 1))) == (2, 3)
    assert value(P.multiply(p, 2)) == (6, 8) and value(P.divide(p, 2)) == (1.5, 2) and value(P.floor_divide(P.point(-7, 7), 2)) == (-4, 3)
    assert value(P.negate(p)) == (-3, -4) and value(P.truth(p)) and not value(P.truth(q))
    assert value(P.scale(P.point(1, 2), 2, (1, 1))) == (1, 3)
    assert near([value(P.rotate(P.point(1, 0), 90))], [(0, 1)]) and near([value(P.reflect(P.point(1, 2), 0))], [(1, -2)])
    assert near([value(P.reflect(P.point(1, 2), 90, (3, 0)))], [(5, 2)])
    assert value(P.round_point(P.point(1.005, -2.5), 0)) == (1, -3) and value(P.round_value(F.lit(1.005), 2)) == 1.0
    assert value(P.angle_to(q, P.point(0, -1))) == 270 and value(P.angle_to(q, q)) is None and value(P.angle_to(q, P.point(1, 1))) == 45
    assert value(P.is_close(P.point(1, 1), P.point(1 + 1e-7, 1))) and not value(P.is_close(p, q))
    assert value(P.epsilon_is_close(P.point(0, 0), P.point(0.00009, 0))) and not value(P.epsilon_is_close(P.point(0, 0), P.point(0.0001, 0)))
    assert value(P.to_text(P.point(1, -2.5))) == "Point(1, -2.5)" and value(P.to_repr(P.point(0, 100))) == "(0, 100)"
    assert value(P.item(p, 1)) == 4
    with pytest.raises(IndexError):
        P.item(p, 2)
    with pytest.raises(TypeError):
        P.as_point("x")
    with pytest.raises(PySparkException):
        value(P.divide(p, 0))


def test_numbers_as_text(value):
    shown = {0.0005: "0.0005", 12345678.5: "12345678.5", 1e21: "1000000000000000000000", 1.5e-7: "0.00000015", -2.25: "-2.25", 100.0: "100", 1e7: "10000000", 0.0: "0", 0.1: "0.1", 123456.789: "123456.789", float("inf"): "inf", float("-inf"): "-inf", 1e-3: "0.001", -1e16: "-10000000000000000"}
    for v, text in shown.items():
        assert value(P.number_text(F.lit(v))) == text
    assert value(P.number_text(F.lit(-0.0))) == "-0" and value(P.number_text(F.lit(float("nan")))) == "NaN" and value(P.number_text(F.lit(None).cast("double"))) is None
    debug = {1.0: "1.0", 0.5: "0.5", 1e16: "1e16", 1.5e-7: "1.5e-7", -3.0: "-3.0", 1e15: "1000000000000000.0", 0.0: "0.0"}
    for v, text in debug.items():
        assert value(P.debug_number(F.lit(v))) == text


def test_texts_have_no_more_digits_than_needed(value):
    """Java before 19 writes some of these with more digits: 2.0000000000000002E22 and the like."""
    for text in ("2e22", "5e19", "1.7e20", "8.41e21", "2e23", "0.000119999", "4.9e-5", "5e-324", "9007199254740993"):
        v = float(text)
        assert value(P.number_text(F.lit(v))) == format(Decimal(repr(v)), "f").removesuffix(".0")
    k = [v * 1e18 for v in range(1, 20000)]
    shown = value(F.array(*[P.number_text(F.lit(v)) for v in k[10::1999]]))
    assert shown == [f"{round(v / 1e18)}{'0' * 18}" for v in k[10::1999]]
    assert value(P.debug_number(F.lit(2e22))) == "2e22" and value(P.debug_number(F.lit(-8.41e21))) == "-8.41e21" and value(P.debug_number(F.lit(5e-324))) == "5e-324"


def test_reprs(value):
    ends = lambda *p: value(H.to_repr(R.as_points(p), F.lit(1), F.lit(2), F.lit(None).cast("int"), F.lit(None).cast("double")))
    assert ends((0, 0), (1, 2.5)) == "Path([(0, 0), (1, 2.5)], 1, 2, Square Ends, 0)"
    assert ends((0, 0), (1, 1), (7, 8)) == "Path([(0, 0), ..., (7, 8)], 1, 2, Square Ends, 0)"
    t = {"text": F.lit("a b"), "origin": P.point(1, 2), "layer": F.lit(3), "magnification": F.lit(2.0), "angle": F.lit(0.5), "x_reflection": F.lit(False), "vertical_presentation": F.lit(0), "horizontal_presentation": F.lit(2)}
    assert value(X.to_repr(t)) == "Text(a b, (1, 2), 3, 2, 0.5, false, Top, Right)"
    assert value(G.to_repr(G.grid((0, 0.5), 2, 3))) == "Grid((0, 0.5), 2, 3, (0, 0), (0, 0), 1.0, 0.0, false)"


def test_rings(value):
    ring = lambda *v: R.as_points(v)
    assert len(value(R.closed(ring((0, 0), (1, 0), (1, 1), (0, 1))))) == 5
    assert value(R.area(ring(*HOUSE))) == 17
    assert value(R.area(ring((0, 0), (2, 1), (4, 2), (2, 1)))) == 0
    assert value(R.length(R.closed(ring((0, 0), (3, 4), (3, 8), (0, 4))))) == 18
    assert abs(value(R.length(R.closed(ring((1, 2), (4, 3))))) - 2 * math.sqrt(10)) < 1e-12
    b = {k: value(v) for k, v in R.bounds(ring((0, 0), (2, 3), (5, 1), (4, -2), (1, -1))).items()}
    assert (b["min_x"], b["min_y"], b["max_x"], b["max_y"]) == (0, -2, 5, 3)
    sq = ring(*SQUARE)
    assert value(R.contains(sq, P.point(1, 1))) and value(R.contains(sq, P.point(2, 0))) and not value(R.contains(sq, P.point(3, 3)))
    assert value(R.on_edge(sq, P.point(1, 2))) and not value(R.on_edge(sq, P.point(1, 1)))
    assert value(R.on_edge(ring((0, 0), (5, 5), (10, 10)), P.point(2, 2)))
    assert value(R.all_of(R.contains, sq, [(1, 1), (2, 2)])) and not value(R.all_of(R.contains, sq, [(1, 1), (9, 9)])) and value(R.any_of(R.contains, sq, [(1, 1), (9, 9)]))
    assert value(R.intersects(sq, ring((2, 0), (2, 2), (4, 2), (4, 0)))) and not value(R.intersects(sq, ring((5, 5), (6, 5), (6, 6))))
    unit = ring((0, 0), (0, 1), (1, 1), (1, 0))
    assert near(pts(value(R.rotate(unit, 90))), [(0, 0), (-1, 0), (-1, 1), (0, 1)])
    assert pts(value(R.move_to(unit, (5, 5))))[2] == (6, 6) and pts(value(R.move_by(unit, (1, 2))))[0] == (1, 2)
    assert len(value(R.regular((0, 0), 1, 6))) == 7
    e = pts(value(R.ellipse((1, 1), 2, 3, n_sides=8)))
    assert len(e) == 9 and e[-1] == (1, 1) and e[0] == (3, 1)
    assert value(R.epsilon_equal(unit, R.move_by(unit, (0.00001, 0)))) and not value(R.epsilon_equal(unit, sq))
    assert value(R.polygon_text(sq, F.lit(1), F.lit(2))) == "Polygon with 5 point(s), starting at (0, 0) on layer 1, data type 2"
    assert value(R.checked_layer(255)) == 255
    for bad in (256, -1):
        with pytest.raises(PySparkException):
            value(R.checked_layer(bad))
    for bad in ([], "abc", 3):
        with pytest.raises(TypeError):
            R.as_points(bad)


def test_invariants(value):
    ring = R.as_points([*HOUSE, HOUSE[0]])
    assert abs(value(R.area(R.rotate(ring, 33, (1, 2)))) - 17) < 1e-9
    assert abs(value(R.area(R.scale(ring, 3))) - 17 * 9) < 1e-9
    assert near(pts(value(R.rotate(ring, 360))), pts(value(ring)))
    assert near(pts(value(R.reflect(R.reflect(ring, 20, (1, 1)), 20, (1, 1)))), pts(value(ring)))


def test_paths(value):
    line = R.as_points([(0, 0), (1, 0), (1, 1)])
    box = lambda p, w: tuple(value(v) for v in H.bounds(p, w).values())
    assert value(H.length(line)) == 2
    assert box(R.as_points([(0, 0), (0, 1)]), F.lit(0.5)) == (-0.25, -0.25, 0.25, 1.25)
    assert near([box(R.as_points([(0, 0), (1, 1)]), F.lit(0.5))], [(-0.25 * 2**0.5, -0.25 * 2**0.5, 1 + 0.25 * 2**0.5, 1 + 0.25 * 2**0.5)])
    assert box(line, F.lit(None).cast("double")) == (0, 0, 1, 1)
    assert box(R.as_points([(1, 1), (1, 1)]), F.lit(2.0)) == (None,) * 4
    assert value(H.type_name(F.lit(1))) == "Round Ends"
    with pytest.raises(PySparkException):
        value(H.type_name(F.lit(7)))
    with pytest.raises(PySparkException):
        value(H.checked([(0, 0)]))
    assert value(H.to_text(line, F.lit(1), F.lit(2), F.lit(None).cast("int"), F.lit(1.5))) == "Path with 3 points on layer 1 with data type 2, Square Ends and width 1.5"


def test_texts(value):
    t = {"text": F.lit("éa"), "origin": P.point(1, 2), "layer": F.lit(3), "magnification": F.lit(2.0), "angle": F.lit(350.0), "x_reflection": F.lit(False), "vertical_presentation": F.lit(0), "horizontal_presentation": F.lit(2)}
    assert tuple(value(v) for v in X.bounds(t["text"], t["origin"], t["magnification"]).values()) == (-2, 1, 4, 3)
    assert value(X.rotate(t, 30)["angle"]) == 380 and value(X.reflect(t, 0)["angle"]) == -350 and value(X.scale(t, 3)["magnification"]) == 6
    assert value(X.presentation_code(F.lit(2), F.lit(1))) == 9 and value(X.presentations(F.lit(9))) == (2, 1)
    for bad in (3, 7, 11, 12, 16, -1):
        with pytest.raises(PySparkException):
            value(X.presentations(F.lit(bad)))
    assert value(X.to_text(t)) == "Text 'éa' vertical: Top, horizontal: Right at (1, 2)"
    assert value(X.equal(t, t)) and not value(X.equal(t, t | {"layer": F.lit(4)}))


def test_grids(value):
    g = G.grid((1, 0), 2, 3, (10, 0), (0, 10), 2, 90, False)
    for a in (90, 180, 270):
        g = G.rotate(g, a)
    assert value(g["angle"]) == 270 and near([tuple(value(g["origin"]))], [(-1, 0)])
    h = G.scale(G.grid((1, 1), spacing_x=(4, 0)), 2, (1, 1))
    assert tuple(value(h["spacing_x"])) == (7, -1) and value(h["magnification"]) == 2
    assert value(G.reflect(G.grid(), 0)["x_reflection"]) is True
    assert value(G.equal(g, g)) and not value(G.equal(g, h))
    assert value(G.to_text(G.grid((0, 0.5), 2, 3))) == "Grid at (0, 0.5) with 2 columns and 3 rows, spacing ((0, 0), (0, 0)), magnification 1.0, angle 0.0, x_reflection false"
    p = value(G.place(G.grid((1, 2), 5, 5, (2, 0), (0, 2), 1, 90), F.lit(1), F.lit(2)))
    assert near([tuple(p)], [(1 - 4, 2 + 2)])
