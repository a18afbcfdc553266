"""Tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names it, or else the context's checkpoint directory; only a local master
without either gets a local folder, a cluster an error.  What is not dropped before goes when the
application ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="tesseraql-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: lineage ends here, and a
    lost executor costs no recomputation.  drop(df) removes the files."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove the files of stored()."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            fs, at = _file_system(df.sparkSession, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)
