"""Streaming ingestion of layout files (an extension): new files in a folder become element rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import gds

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_rows(spark: SparkSession, folder: str, pattern: str = "*.gds", files_per_trigger: int = 64) -> DataFrame:
    """A stream of decoded rows, with the columns of sources.gds.read_rows."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)

    def decode(batches):
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from gds._batches(p, data, None)

    return files.select("path", "content").mapInArrow(decode, gds.ELEMENT)
