"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own, on a local master only: on a cluster each machine
    would write to its own disk, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        at = tempfile.mkdtemp(prefix="planarlake-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str = "level", spark: SparkSession | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again (by another session, if one is given): cuts lineage,
    survives lost executors."""
    spark = spark or df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that are over. It does so when the driver's garbage is collected, which
    may be long after; long operators ask for it once what they shuffled is staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() gave. Only for those that nothing reads any more: what was made of them is staged itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
