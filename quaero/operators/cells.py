"""Nearest neighbours by trained cells.

Spherical k-means on a bounded sample gives centroids; every row lies in the folder of its nearest
one.  A search probes the cells of the nearest centroids: either until no other cell can hold a
better row, which is exact, or a number of cells that was measured to reach a target recall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quaero.operators.scoring import CellKernel, VectorKernel
from quaero.operators.topk import grid_topk, topk_join
from quaero.operators.vector import vector_topk
from quaero.params import Params
from quaero.sources.workdir import run_dir, staged


@dataclass(frozen=True)
class Cells:
    """Rows by cell; ``reach`` is the largest angle of a row to its centroid, ``probes`` what was measured."""

    rows: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray
    probes: int
    recall: float


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def spherical_means(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit rows; starts spread out, empty cells start again from the worst served row."""
    r = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[r.choice(len(x), k, replace=False)] if k else x
    for _ in range(rounds):
        own, best = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 4096):  # bounds the matrix of cosines
            near = x[at:at + 4096] @ c.T
            own[at:at + 4096], best[at:at + 4096] = near.argmax(axis=1), near.max(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=k) == 0)
        if len(empty):
            total[empty] = x[np.argsort(best)[:len(empty)]]
        c = _unit(total)
    return c


def build_cells(rows: DataFrame, params: Params = Params(), folder: str | None = None) -> Cells:
    """Cells of the rows of ``rows(id, embedding, …)`` that have a vector.

    The centroids are fitted on about ``cell_sample`` rows, drawn by a hash of the id; all rows are
    assigned.  There are about the square root of the rows, at most ``most_cells``, so the
    centroids are a bounded broadcast.  The number of probes is measured: about
    ``cell_queries_measured`` rows are searched exactly among all rows, and the least number of
    cells that holds ``target_recall`` of their ``k`` nearest rows is kept.
    """
    spark = rows.sparkSession
    folder = folder or run_dir(spark, "cells")
    rows = rows.where(F.size("embedding") > 0)
    total = rows.count()
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(drawn < params.cell_sample / max(1, total)).select("id", "embedding").toArrow()
    vectors = np.array(sample["embedding"].to_pylist(), np.float64)
    if not len(vectors):
        vectors = np.array(rows.limit(1).toArrow()["embedding"].to_pylist(), np.float64)
    if not len(vectors):
        return Cells(rows.withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), 0, 1.0)
    k = int(min(params.most_cells, max(1, round(total ** 0.5))))
    centroids = spherical_means(_unit(vectors), k, params.cell_rounds)
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("struct<cell:int, angle:double>")
    def nearest(column: pd.Series) -> pd.DataFrame:
        x = _unit(np.stack(column.to_numpy()).astype(np.float64)) if len(column) else np.zeros((0, shared.value.shape[1]))
        near = x @ shared.value.T
        own = near.argmax(axis=1) if len(x) else np.zeros(0, int)
        return pd.DataFrame({"cell": own, "angle": np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))})

    dealt = staged(rows.withColumn("_near", nearest("embedding")).select("*", "_near.cell", "_near.angle").drop("_near"), "dealt", folder)
    per_cell = dealt.groupBy("cell").agg(F.max("angle").alias("reach"), F.count(F.lit(1)).alias("n")).collect()  # one row a cell
    reach, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in per_cell:
        reach[r.cell], sizes[r.cell] = r.reach, r.n
    path = f"{folder}/cells"
    # A cell may hold a large share of the rows: it is written by several tasks.
    salt = F.pmod(F.xxhash64("id"), F.lit(8))
    dealt.drop("angle").repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(path)
    kept = spark.read.schema(T.StructType([*dealt.drop("angle", "cell").schema, T.StructField("cell", T.IntegerType())])).parquet(path)
    cells = Cells(kept, centroids, reach, sizes, len(centroids), 1.0)
    return _measured(cells, dealt, params, total)


def _measured(cells: Cells, dealt: DataFrame, params: Params, total: int) -> Cells:
    """``cells`` with the least number of probes that reaches the target recall."""
    share = params.cell_queries_measured / max(1, total)
    drawn = F.pmod(F.xxhash64(F.lit("measure"), "id"), F.lit(1 << 30)) / float(1 << 30)
    asked = staged(dealt.where(drawn < share).select(F.col("id").alias("query_id"), "embedding"), "measured")
    true = vector_topk(dealt, asked, params.k, params).join(dealt.select("id", "cell"), "id").select("query_id", "cell").toArrow()
    if not true.num_rows:
        return cells
    rows = asked.toArrow()
    near = _unit(np.array(rows["embedding"].to_pylist(), np.float64)) @ cells.centroids.T
    rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    place = {q: i for i, q in enumerate(rows["query_id"].to_pylist())}
    needed = np.sort(rank[[place[q] for q in true["query_id"].to_pylist()], true["cell"].to_numpy()])
    probes = int(needed[min(len(needed) - 1, int(np.ceil(params.target_recall * len(needed))) - 1)]) + 1
    return Cells(cells.rows, cells.centroids, cells.reach, cells.sizes, probes, float(np.mean(needed < probes)))


def _probed(cells: Cells, queries: DataFrame, probes: int) -> DataFrame:
    """``query_id, embedding, bucket``: the cells that each query looks into."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.centroids, cells.sizes > 0))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        centroids, some = shared.value
        for batch in batches:
            x = _unit(np.array(batch.column("embedding").to_pylist(), np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, len(centroids[0])))
            rank = np.argsort(np.argsort(-(x @ centroids.T), axis=1, kind="stable"), axis=1)
            q, cell = np.nonzero((rank < probes) & some)
            at = pa.array(q)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("embedding").take(at), pa.array(cell)],
                                             names=["query_id", "embedding", "bucket"])

    return queries.select("query_id", "embedding").mapInArrow(
        run, f"query_id {kind}, embedding {queries.schema['embedding'].dataType.simpleString()}, bucket long")


def cells_topk(cells: Cells, queries: DataFrame, k: int, params: Params = Params(), threshold: float | None = None,
               normalised: bool = True, exact: bool = False) -> DataFrame:
    """The nearest rows among the probed cells: ``query_id, id, score, rank``; scores are exact.

    Folders of cells that no query probes are not read.  With ``exact`` the first cells only tell how
    near the k-th row is at least.  Then all cells pass by the queries, and a query meets those that
    can still hold a row as near (`CellKernel`): no pair of query and cell is ever a row.
    """
    folder = run_dir(queries.sparkSession, "probes")
    queries = queries.where(F.size("embedding") > 0)
    if not len(cells.centroids):
        return vector_topk(cells.rows, queries, k, params, threshold, normalised)
    kernel = VectorKernel(normalised)
    first = min(cells.probes, params.exact_probes) if exact else cells.probes
    probes = staged(_probed(cells, queries, first), "first", folder)
    named = [r.bucket for r in probes.select("bucket").distinct().collect()]  # at most one row a cell
    rows = cells.rows.where(F.col("cell").isin(named)).withColumn("bucket", F.col("cell").cast("long"))
    hits = grid_topk(rows, probes, kernel, k, params, threshold, bucketed=True)
    if not exact:
        return hits
    kth = staged(hits, "hits", folder).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    least = float("-inf") if threshold is None else float(threshold)
    asked = queries.select("query_id", "embedding").join(kth, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("floor", F.lit(least)).alias("floor"))
    shared = queries.sparkSession.sparkContext.broadcast((cells.centroids, cells.reach))
    return topk_join(cells.rows, asked, CellKernel(normalised, shared=shared), k, params, threshold, distinct=True)
