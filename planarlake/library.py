"""A library of cells as one object: five tables and the operations on them. Every operation gives a new library."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import grid as G
from .functions import path as H
from .functions import point as P
from .functions import ring as R
from .functions import text as X
from .operators import catalog, equality, filters, hierarchy
from .sources import gds

c = F.col
TABLES = ("polygons", "paths", "texts", "references")
TEXT = ("text", "origin", "layer", "magnification", "angle", "x_reflection", "vertical_presentation", "horizontal_presentation")


@dataclass(frozen=True)
class Library:
    """Cells (cell_name, cell_seq) with their polygons, paths, texts and references, keyed by cell_name and elem_id."""

    cells: DataFrame
    polygons: DataFrame
    paths: DataFrame
    texts: DataFrame
    references: DataFrame
    name: str = "Library"

    # Sources and sinks

    @staticmethod
    def empty(spark: SparkSession, name: str = "Library") -> Library:
        made = [spark.createDataFrame([], s).drop("lib_id") for s in (schema.CELLS, schema.POLYGONS, schema.PATHS, schema.TEXTS, schema.REFERENCES)]
        return Library(*made, name)

    @staticmethod
    def from_gds(spark: SparkSession, path: str, round_digits: int | None = None) -> Library:
        """The library of one file, with its name. Several files are several libraries: Libraries reads these."""
        t = gds.read(spark, path, round_digits)
        named = t["libraries"].limit(2).collect()
        if len({r.path for r in named}) > 1:
            raise ValueError(f"{path} has more than one file; Libraries.from_gds keeps them apart")
        return Library(t["cells"].select("cell_name", "cell_seq"), **{k: t[k].drop("path", "lib_id", "cell_seq") for k in TABLES}, name=named[0].lib_id if named else "Library")

    def tables(self) -> dict[str, DataFrame]:
        return {"cells": self.cells} | {k: getattr(self, k) for k in TABLES}

    def to_gds(self, path: str, units: float = 1e-6, precision: float = 1e-10) -> str:
        return gds.write(self.tables(), path, self.name, units, precision)

    def cell_to_gds(self, cell_name: str, path: str, units: float = 1e-6, precision: float = 1e-10) -> str:
        return gds.write_cell(self.tables(), cell_name, path, units, precision)

    # Cells

    def add(self, cells: DataFrame, replace_pre_existing: bool = False) -> Library:
        """With new cells; a name that is there already is an error, or is replaced with its elements."""
        out = replace(self, cells=catalog.add_cells(self.cells, cells, replace_pre_existing))
        if replace_pre_existing:
            out = replace(out, **{k: catalog.remove_cells(getattr(self, k), cells) for k in TABLES})
        return out

    def add_elements(self, **tables: DataFrame) -> Library:
        return replace(self, **{k: getattr(self, k).unionByName(v, allowMissingColumns=True) for k, v in tables.items()})

    def remove(self, names: DataFrame) -> Library:
        return replace(self, **{k: catalog.remove_cells(v, names) for k, v in self.tables().items()})

    def named(self, names: DataFrame) -> DataFrame:
        """Those of the names (cell_name) that cells here have."""
        return names.join(self.cells.select("cell_name"), "cell_name", "left_semi")

    def contains(self, other: Library, epsilon: float = P.EPSILON) -> DataFrame:
        """Names of the cells of other that stand here as well: the same name, and equal elements of each kind, in order.
        References are equal if what they target is, cells under a cell included."""
        both = self.named(other.cells.select("cell_name")).distinct()
        return both.join(equality.unequal_cells(self.tables(), other.tables(), epsilon), "cell_name", "left_anti")

    def remove_elements(self, epsilon: float = P.EPSILON, targets: Library | None = None, **tables: DataFrame) -> Library:
        """Without the elements of each kind that equal a row of the table given for it, in the row's cell. targets: the
        library that references given target something of, if it isn't this one."""
        t = self.tables()
        other = t if targets is None else targets.tables()
        out = {k: catalog.remove_elements(t[k], v, epsilon=epsilon, kind=k) for k, v in tables.items() if k != "references"}
        if "references" in tables:
            out["references"] = equality.references_among(t["references"], tables["references"], t, other, epsilon, among=False)
        return replace(self, **out)

    def contains_elements(self, epsilon: float = P.EPSILON, targets: Library | None = None, **tables: DataFrame) -> dict[str, DataFrame]:
        """Of each table given, the rows that equal an element of that kind in the row's cell; targets as in
        remove_elements."""
        t = self.tables()
        other = t if targets is None else targets.tables()
        out = {k: catalog.contains_elements(t[k], v, epsilon=epsilon, kind=k) for k, v in tables.items() if k != "references"}
        if "references" in tables:
            out["references"] = equality.references_among(tables["references"], t["references"], other, t, epsilon)
        return out

    def counts(self) -> DataFrame:
        return catalog.counts(self.cells, self.polygons, self.paths, self.references, self.texts)

    def empty_cells(self) -> DataFrame:
        return catalog.empty_cells(self.cells, *[getattr(self, k) for k in TABLES])

    def differences(self, other: Library, epsilon: float = P.EPSILON) -> DataFrame:
        """Names of the cells that only one of two libraries has, or that differ between them."""
        mine, theirs = (x.cells.select("cell_name").distinct() for x in (self, other))
        alone = mine.join(theirs, "cell_name", "left_anti").union(theirs.join(mine, "cell_name", "left_anti"))
        differ = equality.unequal_cells(self.tables(), other.tables(), epsilon).join(mine, "cell_name", "left_semi")
        return alone.union(differ).distinct()

    def equals(self, other: Library, epsilon: float = P.EPSILON) -> bool:
        """The same name, the same cell names, and in each cell equal elements of each kind, in order (by epsilon), down
        through what references target."""
        return self.name == other.name and not self.differences(other, epsilon).limit(1).count()

    def shown(self) -> dict[str, DataFrame]:
        """(cell_name, elem_id, text, repr) of the elements of each kind, and (cell_name, text, repr) of the cells."""
        return catalog.shown(self.tables())

    def reachable(self) -> DataFrame:
        return hierarchy.reachable(self.references, self.cells)

    # Measures and filters

    def is_on(self, pairs: filters.Pairs) -> DataFrame:
        return filters.cells_on(self.cells, self.polygons, self.paths, self.texts, self.reachable(), list(pairs))

    def bounding_boxes(self) -> DataFrame:
        """Boxes of all cells, with what their references draw."""
        return hierarchy.cell_boxes(self.cells, self.references, self.polygons, self.paths, self.texts)

    def flatten(self, *pairs: tuple[int, int], depth: int | None = None) -> Library:
        """All cells flattened: references replaced by what they place, to a depth; depth 0 changes nothing."""
        if depth == 0:
            return self
        roots = self.cells.select(c("cell_name").alias("root"))
        flat = hierarchy.flatten(roots, self.references, self.polygons, self.paths, self.texts, list(pairs), depth)
        out = {k: flat[k].drop("cell_name").withColumnRenamed("root", "cell_name").select(*getattr(self, k).columns) for k in ("polygons", "paths", "texts")}
        refs = flat["references"].drop("cell_name").withColumnRenamed("root", "cell_name").select(*self.references.columns) if depth is not None else self.references.limit(0)
        return replace(self, **out, references=refs)

    def elements(self, cell_name: str, *pairs: tuple[int, int], depth: int | None = None) -> Library:
        """A cell's elements on the layers, its own ones too, references expanded to a depth."""
        one = replace(self, cells=self.cells.where(c("cell_name") == cell_name)).flatten(*pairs, depth=depth)
        on, text_on = filters.on_layers(list(pairs)), filters.text_on_layers(list(pairs))
        mine = c("cell_name") == cell_name
        refs = one.references.where(mine)
        if pairs:  # references that are left, whatever level they come from, must be on the layers as a whole
            whole = hierarchy.references_on(hierarchy.with_nested(self.references), self.polygons, self.paths, self.texts, list(pairs))
            refs = refs.join(whole.where("is_on").select("elem_id"), "elem_id", "left_semi").select(*refs.columns)
        return replace(one, polygons=one.polygons.where(mine & on), paths=one.paths.where(mine & on), texts=one.texts.where(mine & text_on), references=refs)

    # Transforms of all elements

    def _moved(self, points, text, grid) -> Library:
        t = text({k: c(k) for k in TEXT})
        texts = self.texts.withColumns({k: t[k] for k in TEXT})
        return replace(
            self, polygons=self.polygons.withColumn("points", points(c("points"))), paths=self.paths.withColumn("points", points(c("points"))),
            texts=texts, references=self.references.withColumn("grid", grid(c("grid"))),
        )

    def move_by(self, vector) -> Library:
        v = P.as_point(vector)
        return self._moved(lambda p: R.move_by(p, v), lambda t: X.move_by(t, v), lambda g: G.move_by(g, v))

    def move_to(self, target) -> Library:
        """Every element to the same point."""
        v = P.as_point(target)
        return self._moved(lambda p: R.move_to(p, v), lambda t: X.move_to(t, v), lambda g: G.move_to(g, v))

    def rotate(self, angle, centre=(0, 0)) -> Library:
        return self._moved(lambda p: R.rotate(p, angle, centre), lambda t: X.rotate(t, angle, centre), lambda g: G.rotate(g, angle, centre))

    def scale(self, factor, centre=(0, 0)) -> Library:
        return self._moved(lambda p: R.scale(p, factor, centre), lambda t: X.scale(t, factor, centre), lambda g: G.scale(g, factor, centre))

    def __add__(self, cells: DataFrame) -> Library:
        return self.add(cells, replace_pre_existing=True)

    def __str__(self) -> str:
        return f"Library '{self.name}' with {self.cells.count()} cells"

    def __repr__(self) -> str:
        return f"Library({self.name})"


#: What stands around the library in the names of cells of several libraries; no file has such names.
MARK = "\1"


@dataclass(frozen=True)
class Libraries:
    """Many libraries in one set of tables, kept apart by the key that each has (the path of its file).

    Cells of one name in different libraries are different cells: names are keyed by library while operators run, and both
    come out as columns, library and cell_name. names: (library, name).
    """

    keyed: Library
    names: DataFrame

    @staticmethod
    def from_gds(spark: SparkSession, path: str, round_digits: int | None = None) -> Libraries:
        """The libraries of all files at a path or pattern."""
        t = gds.read(spark, path, round_digits)
        of = lambda k: _keyed(t[k], "path").drop("lib_id", *(["cell_seq"] if k != "cells" else []))
        return Libraries(Library(of("cells"), **{k: of(k) for k in TABLES}), t["libraries"].select(c("path").alias("library"), c("lib_id").alias("name")))

    @staticmethod
    def of(libraries: dict[str, Library]) -> Libraries:
        """Some libraries by their keys. Elements' ids must differ between them where references target elements."""
        one = next(iter(libraries.values()))
        every = lambda k: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_keyed(v.tables()[k].withColumn("library", F.lit(key)), "library") for key, v in libraries.items()])
        names = one.cells.sparkSession.createDataFrame([(k, v.name) for k, v in libraries.items()], "library string, name string")
        return Libraries(Library(every("cells"), **{k: every(k) for k in TABLES}), names)

    def library(self, key: str) -> Library:
        """One of the libraries."""
        own = lambda d: _parted(d).where(c("library") == key).drop("library")
        name = self.names.where(c("library") == key).select("name").first()
        t = {k: own(v) for k, v in self.keyed.tables().items()}
        t["references"] = t["references"].withColumn("target_cell", _bare(c("target_cell")))
        return Library(**t, name=name.name if name else "Library")

    def tables(self) -> dict[str, DataFrame]:
        """All tables, with library and cell_name."""
        out = {k: _parted(v) for k, v in self.keyed.tables().items()}
        return out | {"references": out["references"].withColumn("target_cell", _bare(c("target_cell")))}

    def flatten(self, *pairs: tuple[int, int], depth: int | None = None) -> Libraries:
        return replace(self, keyed=self.keyed.flatten(*pairs, depth=depth))

    def bounding_boxes(self) -> DataFrame:
        return _parted(self.keyed.bounding_boxes())

    def is_on(self, pairs: filters.Pairs) -> DataFrame:
        return _parted(self.keyed.is_on(pairs))

    def counts(self) -> DataFrame:
        return _parted(self.keyed.counts())

    def empty_cells(self) -> DataFrame:
        return _parted(self.keyed.empty_cells())

    def reachable(self) -> DataFrame:
        return _parted(self.keyed.reachable()).withColumn("below", _bare(c("below")))

    def shown(self) -> dict[str, DataFrame]:
        plain = lambda d: d.withColumns({k: F.regexp_replace(k, f"{MARK}[^{MARK}]*{MARK}", "") for k in ("text", "repr")})
        return {k: plain(_parted(v)) for k, v in self.keyed.shown().items()}

    def differences(self, other: Libraries, epsilon: float = P.EPSILON) -> DataFrame:
        """(library, cell_name) of cells that differ between libraries of the same key, or that only one side has."""
        return _parted(self.keyed.differences(other.keyed, epsilon))

    def move_by(self, vector) -> Libraries:
        return replace(self, keyed=self.keyed.move_by(vector))

    def move_to(self, target) -> Libraries:
        return replace(self, keyed=self.keyed.move_to(target))

    def rotate(self, angle, centre=(0, 0)) -> Libraries:
        return replace(self, keyed=self.keyed.rotate(angle, centre))

    def scale(self, factor, centre=(0, 0)) -> Libraries:
        return replace(self, keyed=self.keyed.scale(factor, centre))

    def to_gds(self, key: str, path: str, units: float = 1e-6, precision: float = 1e-10) -> str:
        """One of the libraries as a file."""
        return self.library(key).to_gds(path, units, precision)


def _keyed(t: DataFrame, library: str) -> DataFrame:
    """A table whose cells' names carry the library (a column, which goes)."""
    name = lambda k: F.concat(F.lit(MARK), c(library), F.lit(MARK), c(k))
    return t.withColumns({k: name(k) for k in ("cell_name", "target_cell") if k in t.columns}).drop(library)


def _bare(name: Column) -> Column:
    return F.when(name.startswith(MARK), F.split_part(name, F.lit(MARK), F.lit(3))).otherwise(name)


def _parted(t: DataFrame) -> DataFrame:
    """The opposite of _keyed: library and cell_name."""
    return t.select(F.split_part("cell_name", F.lit(MARK), F.lit(2)).alias("library"), _bare(c("cell_name")).alias("cell_name"), *[k for k in t.columns if k != "cell_name"])


def polygon(points, layer: Column | int = 0, data_type: Column | int = 0) -> list[Column]:
    """Columns of a polygon row: a closed ring on a checked layer."""
    kind = data_type if isinstance(data_type, Column) else F.lit(data_type)
    return [R.closed(R.as_points(points)).alias("points"), R.checked_layer(layer).alias("layer"), kind.alias("data_type")]


def path(points, layer: Column | int = 0, data_type: Column | int = 0, path_type: int | None = None, width: float | None = None) -> list[Column]:
    """Columns of a path row of two points or more on a checked layer."""
    if path_type is not None and path_type not in schema.PATH_TYPES:
        raise ValueError(f"Invalid path type {path_type}")
    kind = data_type if isinstance(data_type, Column) else F.lit(data_type)
    return [H.checked(points).alias("points"), R.checked_layer(layer).alias("layer"), kind.alias("data_type"), F.lit(path_type).cast("int").alias("path_type"), F.lit(width).cast("double").alias("width")]


def text(value, origin=(0, 0), layer: Column | int = 0, magnification=1.0, angle=0.0, x_reflection=False, vertical: int = 1, horizontal: int = 1) -> list[Column]:
    """Columns of a text row on a checked layer."""
    if vertical not in schema.VERTICAL or horizontal not in schema.HORIZONTAL:
        raise ValueError("Invalid presentation")
    return [
        F.lit(value).alias("text"), P.as_point(origin).alias("origin"), R.checked_layer(layer).alias("layer"), P.num(magnification).alias("magnification"), P.num(angle).alias("angle"),
        F.lit(x_reflection).alias("x_reflection"), F.lit(vertical).alias("vertical_presentation"), F.lit(horizontal).alias("horizontal_presentation"),
    ]
