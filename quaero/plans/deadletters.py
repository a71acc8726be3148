"""Dead letters across runs: a stored queue of rows that a model failed on, tried again when due (H9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from quaero.operators.models import split_failures
from quaero.sources.workdir import run_dir, staged

# One row for each try; the last run of a letter says where it stands.
QUEUE = "step string, key string, attempts int, next_try bigint, done boolean, error string, row string, run bigint"


def _queue(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    try:
        rows = spark.read.schema(QUEUE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], QUEUE)
    return rows if before is None else rows.where(F.col("run") < before)


def letters(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The state of each letter: ``step, key, attempts, next_try, done, error, row``."""
    last = Window.partitionBy("step", "key").orderBy(F.desc("run"))
    return _queue(spark, path, before).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "run")


def _write(rows: DataFrame, path: str, run: int, part: str) -> None:
    names = [f.name for f in T.StructType.fromDDL(QUEUE) if f.name != "run"]
    rows.select(names).write.mode("overwrite").parquet(f"{path}/run={run}/part={part}")


def post(failed: DataFrame, path: str, step: str, key: str, run: int, now: int, pause: int = 60) -> None:
    """Queue the rows of ``failed``, which have an ``error``, after their first failure.

    ``now`` and ``pause`` are seconds.  A run that is repeated replaces what it queued for the step.
    """
    inputs = [c for c in failed.columns if c not in ("error", "attempts")]
    _write(failed.select(
        F.lit(step).alias("step"), F.col(key).cast("string").alias("key"), F.lit(1).alias("attempts"),
        F.lit(now + pause).cast("bigint").alias("next_try"), F.lit(False).alias("done"), "error",
        F.to_json(F.struct(*inputs)).alias("row")), path, run, f"{step}-posted")


def due(spark: SparkSession, path: str, step: str, schema: str, now: int, most: int = 5, before: int | None = None) -> DataFrame:
    """The rows of a step whose next try has come, as they were sent, with ``attempts`` so far."""
    waiting = letters(spark, path, before).where(
        (F.col("step") == step) & ~F.col("done") & (F.col("next_try") <= now) & (F.col("attempts") < most))
    return waiting.select(F.from_json("row", schema).alias("r"), "attempts").select("r.*", "attempts")


def replay(spark: SparkSession, path: str, step: str, schema: str, key: str, work: Callable[[DataFrame], DataFrame],
           run: int, now: int, pause: int = 60, most: int = 5) -> DataFrame:
    """Try the due letters of a step again; returns the rows that worked now.

    ``work`` maps the rows to their results with an ``error`` column, as `apply_model` does.  What
    works is closed and never sent again; what fails waits twice as long each time, up to ``most``
    attempts.  A run that is repeated sees the queue as it was before that run.
    """
    folder = run_dir(spark, "replay")
    rows = staged(due(spark, path, step, schema, now, most, run), "due", folder)
    good, bad = split_failures(work(rows))
    names = rows.columns
    inputs = [c for c in names if c != "attempts"]
    tries = F.col("attempts") + 1

    def after(part: DataFrame, done: bool) -> DataFrame:
        error = F.lit(None).cast("string") if done else F.col("error")
        wait = F.lit(now) + F.lit(pause) * F.pow(F.lit(2), F.col("attempts")).cast("bigint")
        return part.select(F.lit(step).alias("step"), F.col(key).cast("string").alias("key"), tries.alias("attempts"),
                           wait.cast("bigint").alias("next_try"), F.lit(done).alias("done"), error.alias("error"),
                           F.to_json(F.struct(*inputs)).alias("row"))

    _write(after(good, True).unionByName(after(bad, False)), path, run, f"{step}-tried")
    return good.drop("attempts")
