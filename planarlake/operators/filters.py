"""Layer filters on element tables, and membership of whole cells and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pairs = list[tuple[int, int]]


def on_layers(pairs: Pairs, layer: Column | None = None, data_type: Column | None = None) -> Column:
    """Whether (layer, data_type) is one of the pairs; no pairs let all through. A literal test, so it is pushed down."""
    layer = F.col("layer") if layer is None else layer
    data_type = F.col("data_type") if data_type is None else data_type
    if not pairs:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [(layer == p) & (data_type == q) for p, q in pairs])


def text_on_layers(pairs: Pairs, layer: Column | None = None) -> Column:
    """Texts have no data type: the layer alone decides."""
    layer = F.col("layer") if layer is None else layer
    return layer.isin(sorted({p for p, _ in pairs})) if pairs else F.lit(True)


def is_on(elements: DataFrame, pairs: Pairs) -> DataFrame:
    return elements.where(on_layers(pairs))


def texts_on(texts: DataFrame, pairs: Pairs) -> DataFrame:
    return texts.where(text_on_layers(pairs))


def is_on_table(elements: DataFrame, layers: DataFrame) -> DataFrame:
    """Rows whose (layer, data_type) stands in a table; a semi join that Spark broadcasts when the table is small."""
    return elements.join(layers, ["layer", "data_type"], "left_semi")


def members(polygons: DataFrame, paths: DataFrame, texts: DataFrame, pairs: Pairs) -> DataFrame:
    """(cell_name, good) of each element: whether it is on the layers."""
    parts = [
        polygons.select("cell_name", on_layers(pairs).alias("good")),
        paths.select("cell_name", on_layers(pairs).alias("good")),
        texts.select("cell_name", text_on_layers(pairs).alias("good")),
    ]
    return reduce(DataFrame.unionByName, parts)


def cells_on(cells: DataFrame, polygons: DataFrame, paths: DataFrame, texts: DataFrame, reach: DataFrame, pairs: Pairs) -> DataFrame:
    """(cell_name, is_on): all members on the layers, those of cells below included; empty cells are on every layer.

    reach has (cell_name, below) of each cell and itself, as hierarchy.reachable gives it.
    """
    bad = members(polygons, paths, texts, pairs).where(~F.col("good")).select(F.col("cell_name").alias("below")).distinct()
    off = reach.join(bad, "below", "left_semi").select("cell_name").distinct().withColumn("off", F.lit(True))
    return cells.select("cell_name").join(off, "cell_name", "left").select("cell_name", F.col("off").isNull().alias("is_on"))
