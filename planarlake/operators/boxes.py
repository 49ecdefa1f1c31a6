"""Bounding boxes of element tables and their union over cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import path, ring, text

BOX = ("min_x", "min_y", "max_x", "max_y")


def _with(df: DataFrame, bounds: dict) -> DataFrame:
    return df.select("*", *[v.alias(k) for k, v in bounds.items()])


def polygon_boxes(polygons: DataFrame) -> DataFrame:
    return _with(polygons, ring.bounds(F.col("points")))


def path_boxes(paths: DataFrame) -> DataFrame:
    return _with(paths, path.bounds(F.col("points"), F.col("width")))


def text_boxes(texts: DataFrame) -> DataFrame:
    return _with(texts, text.bounds(F.col("text"), F.col("origin"), F.col("magnification")))


def union_boxes(boxes: list[DataFrame], keys: list[str]) -> DataFrame:
    """Smallest box around all rows of each key; min and max are combined before they are shuffled."""
    every = reduce(DataFrame.unionByName, [b.select(*keys, *BOX) for b in boxes])
    return every.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def cell_boxes(polygons: DataFrame, paths: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    return union_boxes([polygon_boxes(polygons), path_boxes(paths), text_boxes(texts)], keys)
