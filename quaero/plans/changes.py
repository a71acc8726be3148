"""The change feed of a synced index: what each sync did, with the rows before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quaero.plans.index import SCHEMA, _log
from quaero.plans.named import named
from quaero.sources.workdir import staged

IMAGE = ("url", "content", "content_hash")


def changes(spark: SparkSession, path: str, after: int | None = None, upto: int | None = None,
            columns: tuple[str, ...] = IMAGE) -> DataFrame:
    """``batch_id, id, change`` and the image of the row, for the syncs after ``after`` up to ``upto``.

    ``change`` is insert, update_before, update_after or delete; a deleted row shows its last state.
    Only the changes are read whole.  For the states before, earlier syncs are cut to the changed ids
    first, key against key.  Syncs that are not there give no row.
    """
    log = _log(spark, path, None)
    if upto is not None:
        log = log.where(F.col("batch_id") <= upto)
    new = log if after is None else log.where(F.col("batch_id") > after)
    shown = new.where("op <> 'delete'").select(
        "batch_id", "id", F.when(F.col("op") == "insert", "insert").otherwise("update_after").alias("change"), *columns)
    changed = new.where("op <> 'insert'").select("id", F.col("batch_id").alias("at"), "op")
    earlier = log.where("op <> 'delete'").join(changed.select("id").distinct(), "id", "left_semi").select("id", "batch_id", *columns)
    paired = changed.join(earlier, "id").where(F.col("batch_id") < F.col("at"))
    latest = paired.groupBy("id", "at", "op").agg(F.max_by(F.struct(*columns), "batch_id").alias("image"))
    before = latest.select(
        F.col("at").alias("batch_id"), "id", F.when(F.col("op") == "update", "update_before").otherwise("delete").alias("change"),
        *[F.col("image")[c].alias(c) for c in columns])
    return shown.unionByName(before)


def apply_changes(state: DataFrame, feed: DataFrame) -> DataFrame:
    """The state ``id`` and image after the changes of a feed: the last change of each id counts."""
    columns = [c for c in state.columns if c != "id"]
    feed = feed.where("change <> 'update_before'")
    last = Window.partitionBy("id").orderBy(F.desc("batch_id"))
    final = staged(feed.select("id", "batch_id", "change").withColumn("_n", F.row_number().over(last)).where("_n = 1"), "last")
    # A delete has no row after it, so only the others are read with their image.
    shown = feed.where(F.col("change").isin("insert", "update_after"))
    after = named(shown, ["id", "batch_id"], final.where("change <> 'delete'"))
    untouched = named(state, ["id"], state.select("id").join(final.select("id"), "id", "left_anti"))
    return untouched.select("id", *columns).unionByName(after.select("id", *columns))


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """The syncs as a stream for a consumer with its own checkpoint: ``batch_id, id, op`` and the image after.

    A delete has the id alone.  A consumer that needs the rows before asks `changes` for the batch.
    A sync that is run again under its old number writes new files, so its rows come again.
    """
    return spark.readStream.schema(SCHEMA).option("basePath", path).parquet(path).select("batch_id", "id", "op", *IMAGE)
