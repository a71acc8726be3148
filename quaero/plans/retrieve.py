"""K3: search for a table of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quaero.operators.cells import cells_topk
from quaero.operators.keyword import hybrid_topk, keyword_topk, weighted_queries
from quaero.operators.postings import postings_topk
from quaero.operators.vector import embed, matching, vector_lsh_topk, vector_topk
from quaero.params import Params
from quaero.plans.index import Index

MODES = ("vector", "ann", "keyword", "hybrid")


def retrieve(searches: DataFrame, index: Index, k: int | None = None,
             threshold: float | None = None, mode: str = "hybrid", where: dict | None = None,
             params: Params = Params(), embedder=None, fusion: str = "linear") -> DataFrame:
    """``query_id, id, score, rank`` for ``searches(query_id, text)``.

    ``vector`` scores every row; ``ann`` only those in the nearest cells of an index that has cells,
    as many as were measured to reach ``target_recall``; without cells those that share a signature
    with the search.  ``keyword`` reads the postings of an index that has them, with the same hits.  Searches may bring an ``embedding`` of their own.
    ``where`` keeps index rows by equality before anything is scored.  A threshold works on
    scores in [0, 1], so it does not go with ``keyword``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    k = params.k if k is None else k
    if mode == "keyword":
        if threshold is not None:
            raise ValueError("BM25 scores have no fixed scale; use mode='hybrid' with a threshold")
        if index.postings is not None and not where:
            hits = postings_topk(index.postings, weighted_queries(searches, index.stats), k)
            if hits is not None:
                return hits
        return keyword_topk(index.rows, searches, index.stats, k, params, "text", where)
    embedded = searches if "embedding" in searches.columns else embed(searches, "text", params, embedder)
    if mode == "vector":
        return vector_topk(index.rows, embedded, k, params, threshold, where=where)
    if mode == "ann" and index.cells is not None and not where:
        return cells_topk(index.cells, embedded, k, params, threshold)
    if mode == "ann":
        return vector_lsh_topk(matching(index.rows, where), embedded, k, params.embed_dim, params.lsh_bands,
                               params.lsh_bits, params, threshold)
    return hybrid_topk(index.rows, embedded, index.stats, k, params, "text", fusion, threshold,
                       where)


def payload(hits: DataFrame, index: Index, columns=("url", "content"), params: Params = Params()) -> DataFrame:
    """Fetch what is asked of the hits only after the cut to k.

    Texts are not shuffled for few hits, nor hits for the narrow columns of an index that is not too large.
    """
    rows = rows_of(index, hits, columns, params)
    if not {"content", "terms", "embedding"} & set(columns):
        small = index.stats is not None and index.stats.rows <= params.broadcast_hits
        return hits.join(F.broadcast(rows) if small else rows, "id")
    few = hits.limit(params.broadcast_hits + 1).count() <= params.broadcast_hits
    return (F.broadcast(hits) if few else hits).join(rows, "id")


def rows_of(index: Index, hits: DataFrame, columns=("url", "content"), params: Params = Params()) -> DataFrame:
    """``id`` and ``columns`` of the index, at least of the rows that the hits name.

    An index with a lookup table, sorted by id, is read by the ranges of ids that the hits lie in,
    which parquet readers hold against the statistics of row groups and pages.
    """
    if index.lookup is None or not set(columns) <= set(index.lookup.columns):
        return index.rows.select("id", *columns)
    return in_ranges(index.lookup, hits, params).select("id", *columns)


def in_ranges(rows: DataFrame, hits: DataFrame, params: Params = Params()) -> DataFrame:
    """``rows`` cut to the ranges that the ids of ``hits`` lie in; all rows if there are too many ids."""
    ids = hits.select("id").distinct()
    some = ids.limit(params.lookup_ids + 1).toArrow()["id"].to_numpy()  # a bounded number of longs
    if len(some) > params.lookup_ids:
        return rows
    some = np.sort(some)
    gaps = np.sort(np.argsort(-np.diff(some), kind="stable")[:params.lookup_ranges - 1])
    named = F.lit(False)
    for part in np.split(some, gaps + 1):
        if len(part):
            named = named | F.col("id").between(int(part[0]), int(part[-1]))
    return rows.where(named)
