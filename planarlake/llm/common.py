"""Helpers shared by the corpus operators: staging, sizing, Arrow access and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, release, staged  # noqa: F401

#: Characters that part words in most contracts: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, mb: float, least: int = 8) -> int:
    """How many partitions of about ``mb`` MB of stored input ``df`` makes, by the size the plan states.

    It only sets how finely work is dealt out; no result depends on it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:  # unknown, as for rows that come from the driver
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, size // int(mb * 1e6) + 1)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % mod


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of an Arrow string or binary array; a null is an empty text."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if offs is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches, text: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of at most ``max_bytes`` of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = utf8(b.column(b.schema.get_field_index(text)))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def raw_texts(arr: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null becomes b''."""
    data, offs = utf8(arr)
    buf, o = data.tobytes(), offs.tolist()
    return [buf[a:b] for a, b in zip(o, o[1:])]


class Forest:
    """Union-find over hashable nodes; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def pairs(self):
        return [(x, self.root(x)) for x in list(self.up)]


def _forest_of(batches):
    f = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            f.join(x, y)
    found = [p for p in f.pairs() if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["u", "v"])


#: So many edges (16 bytes each) are joined up in one task; beyond, star rounds shrink the graph first.
ONE_TASK_EDGES = 400_000


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to (node, root): root is the smallest node that can be reached; roots themselves are left out.

    Large-star and small-star rounds, each preceded by forests within partitions, until the edges are stars or few
    enough for one task. No node's neighbours are ever gathered into a list.
    """
    e = staged(edges.select("u", "v").where("u <> v").distinct(), "edges")
    n = e.count()
    while n > ONE_TASK_EDGES:
        local = e.repartition(max(2, n // ONE_TASK_EDGES + 1)).mapInArrow(_forest_of, "u long, v long")
        both = local.union(local.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = staged(small.where("u <> v").distinct(), "edges")
        # Stars: no root is itself a child, and each child has one root.
        roots = new.select(F.col("v").alias("r")).distinct()
        moved = new.join(roots, F.col("u") == F.col("r"), "left_semi").limit(1).count() or new.groupBy("u").count().where("count > 1").limit(1).count()
        discard(e, large)
        e, n = new, new.count()
        if not moved:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return e.repartition(1).mapInArrow(_forest_of, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("root"))
