"""Tables of the layout model: one narrow table a kind of element, keyed by library, cell and element."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POINTS = T.ArrayType(POINT)
GRID = T.StructType(
    [
        T.StructField("origin", POINT),
        T.StructField("columns", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("spacing_x", POINT),
        T.StructField("spacing_y", POINT),
        T.StructField("magnification", T.DoubleType()),
        T.StructField("angle", T.DoubleType()),
        T.StructField("x_reflection", T.BooleanType()),
    ]
)


def _table(*own: tuple[str, T.DataType]) -> T.StructType:
    key = [("lib_id", T.StringType()), ("cell_name", T.StringType()), ("elem_id", T.LongType()), ("elem_seq", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in (*key, *own)])


I, D, S, B = T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
CELLS = T.StructType([T.StructField("lib_id", S), T.StructField("cell_name", S), T.StructField("cell_seq", T.LongType())])
POLYGONS = _table(("layer", I), ("data_type", I), ("points", POINTS))
PATHS = _table(("layer", I), ("data_type", I), ("path_type", I), ("width", D), ("points", POINTS))
TEXTS = _table(("layer", I), ("text", S), ("origin", POINT), ("magnification", D), ("angle", D), ("x_reflection", B), ("vertical_presentation", I), ("horizontal_presentation", I))
REFERENCES = _table(("target_kind", S), ("target_cell", S), ("target_elem_id", T.LongType()), ("grid", GRID))

#: Names of the enumerations by number.
PATH_TYPES = {0: "Square Ends", 1: "Round Ends", 2: "Overlap Ends"}
VERTICAL = {0: "Top", 1: "Middle", 2: "Bottom"}
HORIZONTAL = {0: "Left", 1: "Centre", 2: "Right"}
