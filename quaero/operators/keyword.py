"""Keyword search and its statistics (C4, D-10, E3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quaero.functions.arrays import exploded
from quaero.functions.text import terms
from quaero.operators.scoring import BlendKernel, PairKernel, TermKernel
from quaero.operators.topk import blend_topk, fits_broadcast, rank_within, topk_join
from quaero.operators.vector import matching, vector_topk
from quaero.params import Params
from quaero.sources.workdir import staged


@dataclass(frozen=True)
class CorpusStats:
    """What BM25 needs to know of the whole corpus.  ``terms`` is a table ``term, df``."""

    terms: DataFrame
    rows: int
    avg_len: float


def term_counts(index: DataFrame) -> DataFrame:
    """In how many rows each term occurs; a count per task comes before the shuffle."""
    return (
        exploded(index, [], F.array_distinct("terms"), "term")
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )


def corpus_stats(index: DataFrame, term_table: DataFrame | None = None) -> CorpusStats:
    rows, avg_len = index.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    return CorpusStats(term_counts(index) if term_table is None else term_table,
                       rows, float(avg_len or 1.0) or 1.0)


def idf(df: Column, rows: int) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(rows)) - df + 0.5) / (df + 0.5))


def question_terms(queries: DataFrame, text: str) -> DataFrame:
    """Distinct terms per query: ``query_id, term``."""
    return exploded(queries, ["query_id"], F.array_distinct(terms(text)), "term")


def term_weights(queries: DataFrame, stats: CorpusStats, text: str = "text") -> DataFrame:
    """``query_id, term, df, idf`` for the query terms that the corpus knows.

    The vocabulary is cut to the words asked for first, key against key; what is left is small
    enough for Spark to broadcast in most cases, so a word in every question makes no hot spot.
    """
    asked = question_terms(queries, text)
    known = stats.terms.join(asked.select("term").distinct(), "term", "left_semi")
    return (
        asked.join(known, "term")
        .select("query_id", "term", "df", idf(F.col("df"), stats.rows).alias("idf"))
    )


def weighted_queries(queries: DataFrame, stats: CorpusStats, text: str = "text",
                     known: DataFrame | None = None) -> DataFrame:
    """One row per query with its known terms and their weights.

    A group holds the distinct terms of one question, so its size is that of one text.
    ``known`` are term weights that are there already.
    """
    known = term_weights(queries, stats, text) if known is None else known
    return (
        known.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t"))
        .select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("weights"))
    )


def with_terms(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("terms", terms(text))


def keyword_topk(index: DataFrame, queries: DataFrame, stats: CorpusStats, k: int,
                 params: Params = Params(), text: str = "text",
                 where: dict | None = None) -> DataFrame:
    """Exact BM25 top-k; rows without a common term are no hits.

    Every index row carries its own terms, so a row meets all queries where it lies.  A join on
    the term would send each frequent word to one place together with all rows that hold it.
    """
    kernel = TermKernel(stats.avg_len, params.bm25_k1, params.bm25_b)
    weighted = staged(weighted_queries(queries, stats, text), "weighted")
    # Searches for the same words have the same hits, so that each set of words is searched once.
    known = staged(weighted.groupBy("terms", "weights").agg(F.collect_set("query_id").alias("all"))
                   .select("terms", "weights", F.array_min("all").alias("query_id"), "all"), "known")
    hits = topk_join(matching(index, where), known, kernel, k, params)
    named = known.where(F.size("all") > 1).select("query_id", F.explode("all").alias("same"))
    if not named.take(1):
        return hits
    return hits.join(named, "query_id", "left").withColumn("query_id", F.coalesce("same", "query_id")).drop("same")


def rrf_topk(first: DataFrame, second: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked hit lists, scaled so that two first ranks give 1."""
    share = (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part")
    both = first.select("query_id", "id", share).unionByName(second.select("query_id", "id", share))
    fused = both.groupBy("query_id", "id").agg(
        F.round(F.sum("part") * F.lit((constant + 1) / 2.0), 6).alias("score"))
    ranked = rank_within(fused, "query_id", [F.desc("score"), F.asc("id")])
    return ranked.where(F.col("rank") <= k)


def hybrid_topk(index: DataFrame, queries: DataFrame, stats: CorpusStats, k: int,
                params: Params = Params(), text: str = "text", fusion: str = "linear",
                threshold: float | None = None, where: dict | None = None) -> DataFrame:
    """Vector and keyword search in one ranking.

    ``linear`` blends both scores of every index row and is graded in [0, 1], so that a
    threshold means something; rows and queries without a vector count by their words.  The index is
    read once (`blend_topk`), or, for queries beyond the broadcast bound, once for the best BM25 of
    each query and once for the blend.  ``rrf`` only looks at the ranks of the two top-k lists.
    """
    if fusion == "rrf":
        if threshold is not None:
            raise ValueError("a threshold needs fusion='linear'")
        return rrf_topk(vector_topk(index, queries, k, params, where=where),
                        keyword_topk(index, queries, stats, k, params, text, where), k,
                        params.rrf_constant)
    if fusion != "linear":
        raise ValueError(f"unknown fusion {fusion!r}")
    lexical = weighted_queries(queries, stats, text)
    kernel = TermKernel(stats.avg_len, params.bm25_k1, params.bm25_b)
    rows = matching(index, where)
    pair = PairKernel(kernel, params.vector_weight)
    asked = staged(queries.select("query_id", "embedding").join(lexical, "query_id", "left").select(
        "query_id", "embedding", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
        F.coalesce("weights", F.array().cast("array<double>")).alias("weights")), "asked")
    if params.vector_weight >= 0.001 and fits_broadcast(asked, pair, params):
        return blend_topk(rows, asked, pair, k, params, threshold)
    best = topk_join(rows, lexical, kernel, 1, params).select("query_id", F.col("score").alias("best"))
    blended = asked.join(best, "query_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return topk_join(rows, blended, BlendKernel(kernel, params.vector_weight), k, params, threshold)
