"""Reading and writing GDSII files as tables.

Files are read in parts (gds_parts), many tasks a file, from any store that Spark reads, and decoded once: rows are written
to the shared folder, and their ids with them. Writing encodes elements on the executors, puts them in file order by a range
sort, and leaves the file's parts to Spark's committer; then they are joined in the JVM under another name, which becomes
the file's own at the end. What goes wrong before leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import grid as G
from ..functions import point as P
from ..operators import hierarchy
from ..staging import shared_dir, staged
from . import gds_codec as K
from . import gds_parts

ELEMENT = (
    "path string, kind string, lib_id string, cell_name string, cell_seq long, elem_seq long, layer int, data_type int, path_type int, width double, "
    "points array<struct<x:double,y:double>>, text string, origin struct<x:double,y:double>, magnification double, angle double, x_reflection boolean, "
    "vertical_presentation int, horizontal_presentation int, columns long, rows long, spacing_x struct<x:double,y:double>, spacing_y struct<x:double,y:double>, target_cell string"
)
_XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW = pa.schema(
    [
        ("path", pa.string()), ("kind", pa.string()), ("lib_id", pa.string()), ("cell_name", pa.string()), ("cell_seq", pa.int64()), ("elem_seq", pa.int64()), ("layer", pa.int32()),
        ("data_type", pa.int32()), ("path_type", pa.int32()), ("width", pa.float64()), ("points", pa.list_(_XY)), ("text", pa.string()), ("origin", _XY), ("magnification", pa.float64()),
        ("angle", pa.float64()), ("x_reflection", pa.bool_()), ("vertical_presentation", pa.int32()), ("horizontal_presentation", pa.int32()), ("columns", pa.int64()), ("rows", pa.int64()),
        ("spacing_x", _XY), ("spacing_y", _XY), ("target_cell", pa.string()),
    ]
)
#: Where the end of a cell stands in its order, and the tables of the kinds of element.
END_OF_CELL = 99
TABLE_KINDS = (("paths", "path"), ("polygons", "polygon"), ("texts", "text"), ("references", "reference"))
#: Rows of one Arrow batch, and bytes of a piece of a file.
BATCH, PIECE = 4096, 8 << 20


def _batch(path: str, rows: list[dict]) -> pa.RecordBatch:
    """Rows of decode_raw as one Arrow batch, column by column; all points are worked out at once."""
    pair = lambda k: pa.array([None if (p := e.get(k)) is None else {"x": p[0], "y": p[1]} for e in rows], _XY)
    names = {"vertical_presentation": "vertical", "horizontal_presentation": "horizontal"}
    columns = []
    for f in ARROW:
        if f.name == "path":
            columns.append(pa.repeat(pa.scalar(path, pa.string()), len(rows)))
        elif f.name == "points":
            raw = [e.get("xy") for e in rows]
            first = next((e for e in rows if "xy" in e), None)
            x, y = K.coordinates(b"".join(r for r in raw if r), first["unit"], first["digits"]) if first else (pa.array([], pa.float64()),) * 2
            size = np.array([len(r) // 8 if r else 0 for r in raw], np.int32)
            offs = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32), mask=np.array([r is None for r in raw] + [False]))
            points = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
            columns.append(pa.ListArray.from_arrays(offs, points).cast(f.type))
        elif f.type == _XY:
            columns.append(pair(f.name))
        else:
            k = names.get(f.name, f.name)
            columns.append(pa.array([e.get(k) for e in rows], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def _batched(path: str, events) -> Iterator[pa.RecordBatch]:
    rows, unit = [], None
    for e in events:
        now = (e["unit"], e["digits"]) if "xy" in e else unit
        if len(rows) == BATCH or rows and unit is not None and now != unit:  # units may change within a file
            yield _batch(path, rows)
            rows = []
        rows.append(e)
        unit = now
    if rows:
        yield _batch(path, rows)


def _batches(path: str, data: bytes, digits: int | None):
    return _batched(path, K.decode_raw(data, digits))


def read_rows(spark: SparkSession, path: str, round_digits: int | None = None) -> DataFrame:
    """All rows of the files at a path or pattern; kind tells what each one is. A task reads a split of a file, however
    large the file is; what it has to know of the splits before is found in a pass over the files beforehand."""
    own = spark.newSession()  # both passes must see the same splits, whatever executors come and go
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        if (v := spark.conf.get(k, None)) is not None:
            own.conf.set(k, v)
    pieces = gds_parts.pieces(own, path)
    parts = spark.sparkContext.broadcast(gds_parts.found(pieces, round_digits))

    def decode(batches):
        for (path, block, _), some in groupby(gds_parts.runs(batches), key=lambda x: x[0]):
            yield from _batched(path, gds_parts.events(parts.value[path, block], round_digits, (x[1] for x in some)))

    return pieces.mapInArrow(decode, ELEMENT)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """libraries, cells, polygons, paths, texts and references of decoded rows. Of cells with one name in a file the last one counts;
    references name their cell, so that they find it by a join. Elements have the elem_id of their row, if rows have one."""
    last = rows.where("kind = 'cell'").groupBy("path", "lib_id", "cell_name").agg(F.max("cell_seq").alias("cell_seq"))
    live = rows.join(last.select("path", "cell_seq"), ["path", "cell_seq"], "left_semi")
    key = ["path", "lib_id", "cell_name", "cell_seq", "elem_seq", *(["elem_id"] if "elem_id" in rows.columns else [])]
    of_library = rows.where("kind = 'library'").select("path", "lib_id").distinct()
    of = lambda kind: live.where(F.col("kind") == kind)
    grid = G.grid(F.col("origin"), F.col("columns"), F.col("rows"), F.col("spacing_x"), F.col("spacing_y"), F.col("magnification"), F.col("angle"), F.col("x_reflection"))
    return {
        "libraries": of_library,
        "cells": last,
        "polygons": of("polygon").select(*key, "layer", "data_type", "points"),
        "paths": of("path").select(*key, "layer", "data_type", "path_type", "width", "points"),
        "texts": of("text").select(*key, "layer", "text", "origin", "magnification", "angle", "x_reflection", "vertical_presentation", "horizontal_presentation"),
        "references": of("reference").select(*key, F.lit("cell").alias("target_kind"), "target_cell", F.lit(None).cast("long").alias("target_elem_id"), grid.alias("grid")),
    }


def read(spark: SparkSession, path: str, round_digits: int | None = None) -> dict[str, DataFrame]:
    """The tables of the files at a path or pattern, decoded once; elem_id is fixed by the staged rows."""
    return tables(staged(read_rows(spark, path, round_digits).withColumn("elem_id", F.monotonically_increasing_id()), "gds", spark))


def _elements(b: pa.RecordBatch, kind: str, scale: float) -> list[dict]:
    """The rows of a table of a kind as the codec takes them, points as the file has them."""
    xy = lambda p: (p["x"], p["y"])
    if kind in ("polygon", "path"):
        points = b.column(b.schema.get_field_index("points"))
        offs = points.offsets.to_numpy()
        flat = points.values.slice(offs[0], offs[-1] - offs[0])
        raw = K.raw_points(*(flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)), scale)
        offs = (8 * (offs - offs[0])).tolist()
        rest = b.select([n for n in b.schema.names if n != "points"]).to_pylist()
        return [r | {"kind": kind, "points": raw[i:j]} for r, i, j in zip(rest, offs, offs[1:])]
    out = []
    for r in b.to_pylist():
        if kind == "text":
            r |= {"kind": kind, "origin": xy(r["origin"]), "vertical": r["vertical_presentation"], "horizontal": r["horizontal_presentation"]}
        else:
            g = r["grid"]
            r |= {"kind": kind} | {k: g[k] for k in ("columns", "rows", "magnification", "angle", "x_reflection")} | {k: xy(g[k]) for k in ("origin", "spacing_x", "spacing_y")}
        out.append(r)
    return out


def _encoded(df: DataFrame, kind: str, scale: float) -> DataFrame:
    def encode(batches):
        for b in batches:
            blobs = [K.encode_element(e, scale) for e in _elements(b, kind, scale)] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([K.ORDER[kind]] * len(blobs), pa.int32()), b.column(1), pa.array(blobs, pa.binary())], ["cell_name", "ord", "elem_seq", "blob"])

    rest = [c for c in df.columns if c not in ("cell_name", "elem_seq")]
    return df.select("cell_name", F.col("elem_seq").cast("long").alias("elem_seq"), *rest).mapInArrow(encode, "cell_name string, ord int, elem_seq long, blob binary")


def unnested(refs: DataFrame) -> DataFrame:
    """References in which those to references have become copies of these, grid by grid, however deep."""
    known = refs.select(F.col("elem_id").alias("target_elem_id"), "target_kind", "target_cell", F.col("target_elem_id").alias("next"), F.col("grid").alias("inner"))
    todo, out, seen = refs.where("target_kind = 'reference'"), refs.where("target_kind <> 'reference'"), 0
    left, most = todo.count(), refs.count()
    while left:
        if seen > most:
            raise ValueError("reference refers to itself")
        rest = [c for c in refs.columns if c not in ("target_kind", "target_cell", "target_elem_id", "grid")]
        copies = hierarchy.expand(todo.drop("target_kind", "target_cell").join(known, "target_elem_id"))
        c, g = F.col, F.col("inner")
        placed = G.move_by(G.scale(G.rotate(G._with(g, x_reflection=g["x_reflection"] != c("grid.x_reflection")), c("grid.angle")), c("grid.magnification")), P.point(c("gtx"), c("gty")))
        todo = staged(copies.select(*rest, "target_kind", "target_cell", c("next").alias("target_elem_id"), placed.alias("grid")).select(*refs.columns))
        out, todo = out.unionByName(todo.where("target_kind <> 'reference'")), todo.where("target_kind = 'reference'")
        left, seen = todo.count(), seen + 1
    return out


def materialised(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables in which references to elements have become their copies; elements without a cell only serve as targets."""
    out, refs = dict(t), t["references"]
    if "elem_id" in refs.columns:
        refs = unnested(refs).where("cell_name is not null")
    for name, kind in (("polygons", "polygon"), ("paths", "path"), ("texts", "text")):
        if name not in t:
            continue
        own = refs.where(F.col("target_kind") == kind).select("cell_name", "elem_seq", F.col("target_elem_id").alias("elem_id"), "grid")
        if "elem_id" in t[name].columns:
            target = t[name].drop("cell_name", "elem_seq")
            copies = hierarchy.grid_copies(own.join(target, "elem_id"), kind)
            out[name] = t[name].where("cell_name is not null").unionByName(copies.select(*t[name].columns))
    out["references"] = refs.where("target_kind = 'cell'")
    return out


def _pieces(batches):
    """The blobs of each task's rows, in order, as pieces of about PIECE bytes that end in a zero byte."""
    held, size = [], 0
    for b in batches:
        for x in b.column(0).to_pylist():
            held.append(x)
            size += len(x)
            if size >= PIECE and x[-1] == 0:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["piece"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["piece"])


def _file_order(t: dict[str, DataFrame], parts: list[DataFrame], cells: DataFrame) -> DataFrame:
    """All blobs of the file in order, a range of it a task. A cell's beginning goes with its first element, or its end, so
    that no task's last blob is one (all others end in a zero byte)."""

    def framed(batches):
        for b in batches:
            names, n = b.column(0), b.num_rows
            heads = [K.encode_cell(x, [])[: -len(K.TAIL)] for x in names.to_pylist()]
            for order, blobs in ((-1, heads), (END_OF_CELL, [K._ints(K.ENDSTR, kind=K.NODATA)] * n)):
                yield pa.RecordBatch.from_arrays([names, pa.array([order] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array([bytes(x) for x in blobs], pa.binary())], ["cell_name", "ord", "elem_seq", "blob"])

    frames = cells.select("cell_name").mapInArrow(framed, "cell_name string, ord int, elem_seq long, blob binary")
    keys = [t[n].select("cell_name", F.struct(F.lit(K.ORDER[k]).alias("o"), F.col("elem_seq").cast("long").alias("s")).alias("first")) for n, k in TABLE_KINDS if n in t]
    first = reduce(DataFrame.unionByName, keys).groupBy("cell_name").agg(F.min("first").alias("first"))
    with_first = cells.join(first, "cell_name", "left")
    rows = reduce(DataFrame.unionByName, parts, frames).join(with_first, "cell_name")
    head = F.col("ord") == -1
    rows = rows.withColumn("o", F.when(head, F.coalesce("first.o", F.lit(END_OF_CELL))).otherwise(F.col("ord"))).withColumn("s", F.when(head, F.coalesce("first.s", F.lit(0))).otherwise(F.col("elem_seq")))
    return rows.repartitionByRange("cell_seq", "cell_name", "o", "s").sortWithinPartitions("cell_seq", "cell_name", "ord", "elem_seq")


def write(t: dict[str, DataFrame], path: str, name: str = "Library", units: float = K.UNIT, precision: float = K.PRECISION) -> str:
    """Write tables cells (cell_name, cell_seq), polygons, paths, texts, references to one file; the path comes back."""
    t = materialised(t)
    scale = units / precision
    cells = t["cells"].groupBy("cell_name").agg(F.min("cell_seq").alias("cell_seq"))
    rows = _file_order(t, [_encoded(t[n], k, scale) for n, k in TABLE_KINDS if n in t], cells)
    # Spark's text writer puts bytes down as they are, with a separator behind each row: the zero byte that rows leave out.
    body = rows.select("blob").mapInArrow(_pieces, "piece binary").select(F.expr("substring(piece, 1, length(piece) - 1)").cast("string").alias("value"))
    at = f"{shared_dir(rows.sparkSession)}/gds-{uuid.uuid4().hex}"
    body.write.option("lineSep", "\0").text(at)
    _joined(rows.sparkSession, at, path, K.head(name, units, precision), K.TAIL)
    return path


def _joined(spark: SparkSession, folder: str, path: str, head: bytes, tail: bytes) -> None:
    """One file of the parts in a folder, in order, with something before and after; copied within the JVM."""
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(folder)
    fs, parts_fs = target.getFileSystem(conf), source.getFileSystem(conf)
    under_way = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    parts = sorted((int(f.getPath().getName().split("-")[1]), f.getPath().getName()) for f in parts_fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    try:
        out = fs.create(under_way, True)
        try:
            out.write(bytearray(head))
            for _, part in parts:
                got = parts_fs.open(jvm.org.apache.hadoop.fs.Path(source, part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(got, out, 1 << 20, False)
                finally:
                    got.close()
            out.write(bytearray(tail))
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(under_way, target):
            raise OSError(f"{path} can't be written")
    finally:
        fs.delete(under_way, False)
        parts_fs.delete(source, True)


def write_cell(t: dict[str, DataFrame], cell_name: str, path: str, units: float = K.UNIT, precision: float = K.PRECISION) -> str:
    """Write one cell and all cells under it."""
    reach = hierarchy.reachable(t["references"], t["cells"]).where(F.col("cell_name") == cell_name).select(F.col("below").alias("cell_name"))
    keep = lambda d: d.where("cell_name is null").unionByName(d.join(reach, "cell_name", "left_semi").select(*d.columns))  # noqa: E731  # targets stay
    own = {k: keep(v) if k != "cells" else v.join(reach, "cell_name", "left_semi") for k, v in t.items()}
    first = F.when(F.col("cell_name") == cell_name, -1).otherwise(F.col("cell_seq")).cast("long")
    return write(own | {"cells": own["cells"].withColumn("cell_seq", first)}, path, "library", units, precision)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths, self.digits = options.get("path", ""), options.get("round_digits")

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.paths))]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from _batches(partition.path, f.read(), None if self.digits is None else int(self.digits))


class GdsSource(DataSource):
    """spark.read.format("gds").load(pattern) for paths that all executors can open; read_rows is for other stores."""

    @classmethod
    def name(cls) -> str:
        return "gds"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GdsSource)


def roundtrip(df: DataFrame, kind: str, round_digits: int | None = None) -> DataFrame:
    """Elements (elem_id and the kind's columns) written to and read back from a stream, batch by batch."""

    def there_and_back(batches):
        for b in batches:
            if not b.num_rows:
                continue
            own = [e | {"elem_seq": i} for i, e in enumerate(_elements(b, kind, K.UNIT / K.PRECISION))]
            data = K.head("Library") + K.encode_cell("cell", own) + K.TAIL
            batch = _batch("", [e for e in K.decode_raw(data, round_digits) if e["kind"] == kind])
            yield pa.RecordBatch.from_arrays([b.column(0), *batch.columns], ["elem_id", *batch.schema.names])

    rest = [c for c in df.columns if c != "elem_id"]
    return df.select("elem_id", *rest).mapInArrow(there_and_back, f"elem_id long, {ELEMENT}")


def point_of(name: str):
    return P.point(F.col(f"{name}.x"), F.col(f"{name}.y"))
