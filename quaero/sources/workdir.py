"""Where stage tables go: the shared folder that the cluster names, never a local one on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for local masters."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="quaero-")
    spark.conf.set(_SETTING, folder)
    return folder


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Texts and words take two thirds of the disk that they take with Spark's usual codec.
SMALL = {"compression": "zstd"}


def staged(df: DataFrame, name: str, folder: str | None = None, small: bool = False) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage, so that later stages neither recompute it nor depend on executors that
    may be lost.  ``small`` is for what holds texts or words.
    """
    path = f"{folder or run_dir(df.sparkSession, 'stage')}/{name}"
    df.write.mode("overwrite").options(**(SMALL if small else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, folder: str) -> None:
    """Remove a run's folder once nothing reads its stages any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
