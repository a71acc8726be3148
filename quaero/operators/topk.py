"""Exact and bucketed top-k joins of a query table with an index table.

No pair of query and row ever leaves a task: each task keeps the k best rows per query and
sends only those on, so the shuffle carries queries x k x tasks rows, not queries x rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quaero.operators.scoring import TermKernel, best_of, skyband_of
from quaero.params import Params
from quaero.sources.workdir import staged


def rank_within(df: DataFrame, keys: list[str] | str, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(keys).orderBy(*order)))


def top_k(df: DataFrame, k: int, keys: list[str] | str = "query_id", name: str = "rank") -> DataFrame:
    """The k best rows per key by score, ties by id.  Spark cuts to k before its shuffle too."""
    return rank_within(df, keys, [F.desc("score"), F.asc("id")], name).where(F.col(name) <= k)


def _hits_schema(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id bigint, score double"


def merged_topk(partial: DataFrame, k: int, salts: int = 32) -> DataFrame:
    """The k best of the hits that many tasks found, in two steps.

    A query has up to k hits from each task; no place gets more than a share of these.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(salts))
    first = top_k(partial.withColumn("_salt", salt), k, ["query_id", "_salt"])
    return top_k(first.drop("_salt", "rank"), k)


def side_bytes(side: DataFrame, columns, key: str = "query_id") -> tuple[int, int, int]:
    """Rows of a side, the bytes of its columns and the elements of its lists."""
    def octets(name):
        c = F.col(name)
        if side.schema[name].dataType.simpleString() == "array<string>":
            return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 8)
        return F.size(c).cast("bigint") * 8

    lists = [c for c in columns if side.schema[c].dataType.typeName() == "array"]
    cells = sum((F.coalesce(F.size(c), F.lit(0)).cast("bigint") for c in lists), F.lit(0))
    held = sum((F.coalesce(octets(c), F.lit(0)) for c in lists),
               F.octet_length(F.col(key).cast("string")) + 24)
    return tuple(side.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0)),
                          F.coalesce(F.sum(cells), F.lit(0))).first())


def query_bytes(queries: DataFrame, kernel) -> tuple[int, int]:
    """Rows of the query side and the bytes that scoring it takes in a task."""
    rows, bytes_, cells = side_bytes(queries, kernel.query_columns)
    # A term has a dense column if a 20th of the queries ask for it: at most 20 doubles a cell.
    return rows, bytes_ + 160 * cells


def fits_broadcast(queries: DataFrame, kernel, params: Params) -> bool:
    """Measure the query side before it may be broadcast."""
    rows, bytes_ = query_bytes(queries, kernel)
    return rows <= params.broadcast_queries and bytes_ <= params.broadcast_bytes


def scan_topk(index: DataFrame, queries: DataFrame, kernel, k: int, params: Params,
              min_score: float | None = None, distinct: bool = False) -> DataFrame:
    """Every index partition scores all queries; the index itself is not shuffled.

    With ``distinct`` a pair of query and row that comes twice is one hit, as in `grid_topk`.
    """
    rows = queries.select("query_id", *kernel.query_columns).toArrow()
    shared = index.sparkSession.sparkContext.broadcast(rows)
    tile = params.tile_cells

    def run(batches):
        yield from best_of(batches, shared.value, kernel, k, min_score, tile, distinct)

    partial = index.select("id", *kernel.index_columns).mapInArrow(run, _hits_schema(queries))
    return merged_topk(_once(partial) if distinct else partial, k)


def _once(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def blend_topk(index: DataFrame, queries: DataFrame, kernel, k: int, params: Params,
               min_score: float | None = None) -> DataFrame:
    """The k best of a blend whose second score is divided by its best over all rows, in one scan.

    The best is known only when all rows are read, so each task keeps the rows that may win
    whatever it is, with both scores apart (`Skyband`), and the blend is made of these.
    """
    asked = queries.select("query_id", *kernel.query_columns).toArrow()
    shared = index.sparkSession.sparkContext.broadcast(asked)
    tile, weight, digits = params.tile_cells, kernel.weight, kernel.digits

    def run(batches):
        yield skyband_of(batches, shared.value, kernel, k, tile)

    kind = queries.schema["query_id"].dataType.simpleString()
    found = staged(index.select("id", *kernel.index_columns).mapInArrow(
        run, f"query_id {kind}, id bigint, cos double, lex double"), "band")
    best = found.groupBy("query_id").agg(F.max("lex").alias("best"))  # one row a query

    def blend(batches):
        for batch in batches:
            cos, lex, top = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cos", "lex", "best"))
            top = np.round(top, digits)
            lexical = lex * np.divide(1.0, top, out=np.zeros_like(top), where=top > 0)
            score = np.round(weight * np.maximum(cos, 0.0) + (1.0 - weight) * lexical, digits)
            hit = (cos >= 0) | (lexical > 0)
            if min_score is not None:
                hit &= score >= min_score
            out = pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(score)],
                                             names=["query_id", "id", "score"])
            yield out.filter(pa.array(hit))

    scored = found.join(best, "query_id").select("query_id", "id", "cos", "lex", "best").mapInArrow(blend, _hits_schema(queries))
    return merged_topk(scored, k)


def _ways(index: DataFrame, queries: DataFrame, kernel, k: int, params: Params) -> tuple[int, int]:
    """How many rounds of queries, and the pieces of rows in each.

    A round reads all rows again, a piece returns k hits for each query; a byte that is only read is
    taken for an eighth of one that is shuffled.
    """
    asked, size, lists = side_bytes(queries, kernel.query_columns)
    tasks = 2 * index.sparkSession.sparkContext.defaultParallelism
    read = int(index.select("id", *kernel.index_columns)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    held = max(1, -(-(size + 24 * lists) // max(1, params.broadcast_bytes)), -(-asked // max(1, params.broadcast_queries)))
    ways = [(r, -(-tasks // r)) for r in range(held, max(held, min(tasks, -(-2 * asked // params.cell_queries))) + 1)]
    return min(ways, key=lambda w: (w[0] * read / 8 + w[1] * 24 * k * asked, w[0]))


def rounds_topk(index: DataFrame, queries: DataFrame, kernel, k: int, params: Params,
                min_score: float | None = None) -> DataFrame:
    """The same result as `grid_topk`; neither side is shuffled, only hits are.

    The queries are dealt into rounds small enough to be broadcast, and each round reads all rows, in
    a few pieces.  ``queries`` must be written; a pair that comes twice is one hit.
    """
    rounds, pieces = _ways(index, queries, kernel, k, params)
    rows, tile = index.select("id", *kernel.index_columns).coalesce(pieces), params.tile_cells
    queries = queries.select("query_id", *kernel.query_columns)

    def scan(i: int) -> DataFrame:
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == i).toArrow()
        shared = index.sparkSession.sparkContext.broadcast(some)

        def run(batches):
            yield from best_of(batches, shared.value, kernel, k, min_score, tile, True)

        return rows.mapInArrow(run, _hits_schema(queries))

    partial = reduce(DataFrame.unionByName, (scan(i) for i in range(rounds)))
    # A query has k hits of each piece at most, so one place holds them all: one shuffle for both steps.
    return top_k(_once(partial.repartition("query_id")), k)


# Up to so many buckets their sizes are broadcast: a few MB.
MANY = 100_000


def _tasks(df: DataFrame) -> int:
    """How many task groups a job on two sides is cut into at least, if there is work for so many."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _pieces(index: DataFrame, queries: DataFrame, kernel, k: int, params: Params, bucketed: bool):
    """Function that adds ``row_cells`` and ``query_cells``, the number of pieces, to a side.

    Rows are sent once for each piece of queries, and the other way round, so pieces of a fixed size
    would make what is shuffled grow with the square of the input.  There are as many as the job
    has tasks; more only for queries that are too large to be held at once.
    """
    tasks = _tasks(index)
    if not bucketed:
        rows, row_bytes, _ = side_bytes(index, [f"i_{c}" for c in kernel.index_columns], "id")
        asked, query_size, lists = side_bytes(queries, [f"q_{c}" for c in kernel.query_columns])
        sent = query_size + 24 * k * asked  # a piece of rows gets the queries and returns k hits for each
        held = max(1, -(-(query_size + 40 * lists) // max(1, params.broadcast_bytes)))
        least = max(1, min(tasks, -(-rows // params.cell_rows) * -(-asked // params.cell_queries)))
        ways = [(q, -(-least // q)) for q in range(held, max(held, min(least, -(-asked // params.cell_queries))) + 1)]
        asked_in, rows_in = min(ways, key=lambda w: (w[0] * row_bytes + w[1] * sent, w[0]))
        cells = {"row_cells": F.lit(rows_in), "query_cells": F.lit(asked_in)}
        return lambda side: side.withColumns(cells)
    sizes = staged(
        index.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
        .join(queries.groupBy("bucket").agg(F.count(F.lit(1)).alias("asked")), "bucket"), "sizes")
    # A bucket is cut if it is more than a share of all work, or if its queries are too many to be held.
    some, work = sizes.agg(F.count(F.lit(1)), F.sum(F.col("rows").cast("double") * F.col("asked"))).first()
    share = max(float(params.cell_rows) * params.cell_queries, (work or 0.0) / tasks)
    way = F.ceil(F.sqrt(F.col("rows").cast("double") * F.col("asked") / share))
    held = F.ceil(F.col("asked") / max(params.cell_queries, params.broadcast_queries))
    sizes = sizes.select("bucket", F.least(way, F.col("rows")).cast("int").alias("row_cells"),
                         F.greatest(F.least(way, F.col("asked")), held).cast("int").alias("query_cells"))
    if some <= MANY:
        return lambda side: side.join(F.broadcast(sizes), "bucket")
    # Buckets that are cut are at most as many as the tasks; the rows of no other are too many for one place.
    large = (F.col("row_cells") > 1) | (F.col("query_cells") > 1)
    heavy, light = F.broadcast(sizes.where(large)), sizes.where(~large)

    def add(side):
        rest = side.join(heavy.select("bucket"), "bucket", "left_anti").join(light, "bucket")
        return side.join(heavy, "bucket").unionByName(rest)

    return add


def grid_topk(index: DataFrame, queries: DataFrame, kernel, k: int, params: Params,
              min_score: float | None = None, bucketed: bool = False) -> DataFrame:
    """The same result for any number of queries, and for queries confined to buckets.

    Both sides are cut into pieces by a hash of their id, and each pair of pieces is a cell.  A task
    gets its cells sorted, the queries first: it holds the queries of one cell and the rows pass by
    in batches.  With ``bucketed`` both sides carry a ``bucket`` column and a query only meets the
    rows of its own buckets; a hot bucket is cut into more pieces, so no cell grows with it.
    """
    schema = _hits_schema(queries)
    if not bucketed:
        index = index.withColumn("bucket", F.lit(0).cast("bigint"))
        queries = queries.withColumn("bucket", F.lit(0).cast("bigint"))
    # Own names on either side: index and queries may be views of one table.
    index = index.select("bucket", "id", *(F.col(c).alias(f"i_{c}") for c in kernel.index_columns))
    queries = queries.select(F.col("bucket").alias("bucket"), F.col("query_id").alias("query_id"),
                             *(F.col(c).alias(f"q_{c}") for c in kernel.query_columns))
    with_pieces = _pieces(index, queries, kernel, k, params, bucketed)

    def cut(side: DataFrame, own: str, other: str, key: str) -> DataFrame:
        return (
            with_pieces(side)
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own + "s")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)))
            .drop("row_cells", "query_cells")
        )

    asked = cut(queries, "query_cell", "row_cell", "query_id").withColumn("side", F.lit(0))
    rows = cut(index, "row_cell", "query_cell", "id").withColumn("side", F.lit(1))
    tile = params.tile_cells
    cell = ["bucket", "row_cell", "query_cell"]
    own = {0: ["query_id", *(f"q_{c}" for c in kernel.query_columns)], 1: ["id", *(f"i_{c}" for c in kernel.index_columns)]}
    names = {0: ["query_id", *kernel.query_columns], 1: ["id", *kernel.index_columns]}

    def run(batches):
        parts = _cells(batches, cell)
        part = next(parts, None)
        while part is not None:
            key, held = part[0], []
            while part is not None and part[:2] == (key, 0):
                held.append(part[2].select(own[0]).rename_columns(names[0]))
                part = next(parts, None)

            def rows_of_cell():
                nonlocal part
                while part is not None and part[:2] == (key, 1):
                    yield part[2].select(own[1]).rename_columns(names[1])
                    part = next(parts, None)

            if held:
                yield from best_of(rows_of_cell(), pa.Table.from_batches(held), kernel, k, min_score, tile, True)
            else:
                for _ in rows_of_cell():
                    pass

    both = asked.unionByName(rows, allowMissingColumns=True).repartition(_tasks(index), *cell)
    partial = both.sortWithinPartitions(*cell, "side").mapInArrow(run, schema)
    # A pair may meet in several buckets; its score is the same in each.
    return merged_topk(_once(partial), k)


def _cells(batches, cell: list[str]):
    """The rows of sorted batches as ``cell, side, rows`` in pieces of one cell and side."""
    for batch in batches:
        keys = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in [*cell, "side"]])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if b > a:
                yield tuple(keys[:-1, a].tolist()), int(keys[-1, a]), batch.slice(a, b - a)


def topk_join(index: DataFrame, queries: DataFrame, kernel, k: int, params: Params,
              min_score: float | None = None, distinct: bool = False) -> DataFrame:
    """Exact top-k: broadcast the queries if they are proven small, else use the grid.

    Words are matched in rounds in place of the grid, and also if all tasks' hits were many.
    """
    # Written, as the check and the way taken both read them.
    queries = staged(queries.select("query_id", *kernel.query_columns), "asked")
    asked, size = query_bytes(queries, kernel)
    fits = asked <= params.broadcast_queries and size <= params.broadcast_bytes
    if isinstance(kernel, TermKernel) and params.broadcast_queries and not (fits and asked <= params.scan_queries):
        return rounds_topk(index, queries, kernel, k, params, min_score)
    if fits:
        return scan_topk(index, queries, kernel, k, params, min_score, distinct)
    return grid_topk(index, queries, kernel, k, params, min_score)
