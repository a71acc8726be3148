"""Triggered index sync from a stream of passages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quaero.params import Params
from quaero.plans.index import next_batch, sync_index


def latest_per_id(rows: DataFrame, order: str = "content") -> DataFrame:
    """One row per id within a batch: the greatest by ``order``, in a partial aggregate."""
    others = F.struct(*(c for c in rows.columns if c != "id"))
    return rows.groupBy("id").agg(F.max_by(others, order).alias("r")).select("id", "r.*")


def _first_batch(spark: SparkSession, path: str, checkpoint: str) -> int:
    """The number of the stream's first sync, kept next to its checkpoint."""
    place = f"{checkpoint.rstrip('/')}-first-batch"
    try:
        return spark.read.schema("n bigint").parquet(place).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    n = next_batch(spark, path)
    spark.createDataFrame([(n,)], "n bigint").write.parquet(place)
    return n


def sync_stream(chunks: DataFrame, path: str, checkpoint: str, params: Params = Params(),
                embedder=None, order: str = "content") -> StreamingQuery:
    """Process all files that arrived since the last run, then stop.

    Each micro-batch is one sync.  Its number counts on from what the index held when the
    checkpoint was new, so a stream never touches earlier syncs, and a repeated batch replaces its
    own folder.  One writer at a time.
    """
    first_batch = _first_batch(chunks.sparkSession, path, checkpoint)

    def sync(batch: DataFrame, batch_id: int) -> None:
        sync_index(latest_per_id(batch, order), path, first_batch + batch_id, params, embedder,
                   deletes=False)

    return (chunks.select("id", "url", "content", *({order} - {"id", "url", "content"}))
            .writeStream.foreachBatch(sync)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
