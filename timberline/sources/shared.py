"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where that is unset, a temporary one in local mode, and else one in the warehouse, which executors share, too: a folder
    of this machine's own would lose data on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.timberline.scratch", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_timberline"
        if own.startswith("file:"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.timberline.scratch", own)
    if not own:
        own = tempfile.mkdtemp(prefix="timberline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        own = f"file://{own}"
        spark.conf.set("spark.timberline.scratch", own)
    return own


def pin(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a frame over the written table.

    This cuts the lineage in a way that survives lost executors. ``replaces`` is an earlier pinned frame that nothing
    reads any more; its files are deleted after the new ones exist.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/timberline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._timberline_path = path
    if replaces is not None:
        unpin(replaces)
    return out


def unpin(df: DataFrame) -> None:
    """Deletes the files of a pinned frame that nothing reads any more."""
    path = getattr(df, "_timberline_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
