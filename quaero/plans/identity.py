"""Dense ids: each content gets the next free number once and keeps it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quaero.functions.keys import content_hash
from quaero.operators.numbering import dense_numbers
from quaero.sources.workdir import run_dir, staged

KEYS = "key string, id bigint, batch bigint"
MARKS = "next bigint, batch bigint"


def _before(spark: SparkSession, path: str, schema: str, batch: int | None) -> DataFrame:
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows if batch is None else rows.where(F.col("batch") < batch)


def next_id(spark: SparkSession, path: str, batch: int | None = None) -> int:
    """The number that the next new content gets, seen from ``batch``."""
    last = _before(spark, f"{path}-marks", MARKS, batch).agg(F.max_by("next", "batch")).first()[0]
    return 0 if last is None else last


def assign_ids(rows: DataFrame, path: str, columns: list[str], batch: int) -> DataFrame:
    """``rows`` with ``id``: rows with equal ``columns`` share one, whatever sync brings them.

    New contents get consecutive numbers from the stored mark on, in the order of their 128-bit
    hash, so there are no gaps within a batch and 60-bit collisions don't arise.  The known
    keys are cut to those of the batch first, so a small batch does not shuffle them.  A repeated
    batch replaces its own folder and gives the same ids; later batches are hidden from it.
    """
    spark = rows.sparkSession
    folder = run_dir(spark, "ids")
    keyed = rows.withColumn("_key", content_hash(*columns))
    asked = staged(keyed.select(F.col("_key").alias("key")).distinct(), "asked", folder)
    known = staged(_before(spark, path, KEYS, batch).select("key", "id").join(asked, "key", "left_semi"), "known", folder)
    start = next_id(spark, path, batch)
    fresh = dense_numbers(asked.join(known, "key", "left_anti"), ["key"], "id", start, f"{folder}/fresh").select("key", "id")
    fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    fresh = spark.read.schema("key string, id bigint").parquet(f"{path}/batch={batch}")
    mark = fresh.agg((F.coalesce(F.max("id") + 1, F.lit(start))).alias("next"))
    mark.write.mode("overwrite").parquet(f"{path}-marks/batch={batch}")
    return keyed.join(known.unionByName(fresh), F.col("_key") == F.col("key")).drop("_key", "key")
