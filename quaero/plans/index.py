"""K2: the passage index, kept up to date by what changed.

The index is a folder of parquet files with one sub-folder per sync, ``batch_id=<n>``.  A sync
writes only new, changed and deleted rows; readers take the latest state of each id.  A
repeated sync replaces its own folder, so it may fail and run again at any point.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quaero.functions.arrays import exploded
from quaero.functions.keys import content_hash
from quaero.functions.text import terms
from quaero.operators.cells import Cells, build_cells
from quaero.operators.keyword import CorpusStats, corpus_stats, term_counts
from quaero.operators.postings import Postings, build_postings
from quaero.operators.vector import embed, hashed_vector
from quaero.params import Params
from quaero.plans.named import MOST_KEYS, named
from quaero.sources.workdir import SMALL, forget, run_dir, staged

SCHEMA = (
    "id bigint, url string, content string, content_hash string, text_hash string, "
    "terms array<string>, embedding array<float>, op string, batch_id bigint"
)


@dataclass(frozen=True)
class Index:
    """Searchable rows ``id, url, content, text_hash, terms, embedding`` and their statistics."""

    rows: DataFrame
    stats: CorpusStats | None
    failed: DataFrame | None = None  # ``id, error`` of rows without a vector, if a model made these
    postings: Postings | None = None  # what keyword search reads in part
    cells: Cells | None = None        # what approximate vector search reads in part
    lookup: DataFrame | None = None   # the rows without vectors, sorted by id


def with_terms(chunks: DataFrame) -> DataFrame:
    """Add the search terms and a hash that equal texts share."""
    return chunks.withColumns({"terms": terms("content"), "text_hash": F.md5("content")})


def searchable(chunks: DataFrame, params: Params = Params(), embedder=None) -> DataFrame:
    """Add terms and embedding to ``id, url, content`` rows.

    A row that the embedder fails on stays, without a vector and with the message in ``error``:
    its words can still be searched.
    """
    rows = with_terms(chunks)
    if embedder is None:  # of the terms that are there, so that no text is cut into words twice
        return rows.withColumn("embedding", hashed_vector("terms", params.embed_dim))
    return embed(rows, "content", params, embedder)


def id_conflicts(rows: DataFrame, text: str = "content") -> DataFrame:
    """``id, rows, contents`` of the ids that more than one row has; narrow columns are shuffled."""
    return (rows.select("id", F.md5(F.col(text)).alias("h")).groupBy("id")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("h").alias("contents"))
            .where("rows > 1"))


def refuse_conflicts(rows: DataFrame) -> None:
    """An id names one row in every later join, so an index with a repeated one is refused."""
    found = id_conflicts(rows).select("id").limit(3).collect()  # contents are neither read nor counted
    if found:
        raise ValueError(f"ids that more than one row has: {[r.id for r in found]}, …; see id_conflicts")


def build_index(chunks: DataFrame, params: Params = Params(), embedder=None,
                folder: str | None = None, vectors: bool = True, postings: bool = False,
               cells: bool = False, lookup: bool = False) -> Index:
    """Write rows and term table once; every search reads the written tables.

    Refuses rows that share an id.  ``vectors=False`` leaves the embedding out, for an index that only serves keyword search.
    ``postings``, ``cells`` and ``lookup`` add what keyword search, approximate search and the
    fetching of texts read in part instead of whole; each is one more copy of what it holds.
    """
    folder = folder or run_dir(chunks.sparkSession, "index")
    full = (searchable(chunks, params, embedder) if vectors
            else with_terms(chunks))
    rows = staged(full, "rows", folder, True)
    refuse_conflicts(rows)
    failed = rows.where("error is not null").select("id", "error") if "error" in rows.columns else None
    stats = corpus_stats(rows, staged(term_counts(rows), "terms", folder))
    rows = rows.drop("error")
    return Index(rows, stats, failed, **search_structures(rows, stats, params, folder, postings, cells and vectors, lookup))


def search_structures(rows: DataFrame, stats: CorpusStats, params: Params, folder: str, postings: bool = False,
                      cells: bool = False, lookup: bool = False) -> dict:
    """The parts of an `Index` that searches read in part, written under ``folder``."""
    return {
        "postings": build_postings(rows, stats.avg_len, params, f"{folder}/postings") if postings else None,
        "cells": build_cells(rows.select("id", "embedding"), params, f"{folder}/cells") if cells else None,
        "lookup": by_id(rows, params, f"{folder}/lookup") if lookup else None,
    }


def by_id(rows: DataFrame, params: Params, path: str) -> DataFrame:
    """The rows without vectors in files of disjoint ranges of ids, sorted, with small row groups."""
    narrow = rows.drop("embedding")
    (narrow.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite")
        .option("parquet.block.size", params.lookup_group_bytes).parquet(path))
    return rows.sparkSession.read.schema(narrow.schema).parquet(path)


def load_index(spark: SparkSession, path: str, params: Params = Params(), postings: bool = False,
               cells: bool = False, lookup: bool = False) -> Index:
    """Open the synced index at ``path`` with the statistics of its latest state.

    The search structures are built for that state if asked for.

    Each sync leaves what it changed in the counts, so opening adds these up and does not read
    the passages.
    """
    deltas = spark.read.schema(DELTAS).parquet(_deltas(path))
    rows, sized, words = deltas.where("term IS NULL").agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("rows", "sized", "words")]).first()
    terms_ = deltas.where("term IS NOT NULL").groupBy("term").agg(F.sum("rows").alias("df")).where("df > 0")
    stats = CorpusStats(staged(terms_, "terms"), rows, float(words) / sized if words else 1.0)
    state = current_rows(spark, path)
    built = search_structures(state, stats, params, run_dir(spark, "index"), postings, cells, lookup)
    return Index(state, stats, **built)


# Changes of the counts: rows by term; all rows, those with terms and their terms where it is NULL.
DELTAS = "term string, rows bigint, sized bigint, words bigint"


def _deltas(path: str) -> str:
    return f"{path.rstrip('/')}-terms"


def _write_deltas(added: DataFrame, gone: DataFrame, path: str, batch_id: int) -> None:
    """What rows that come and rows that go change in the counts; both are ``terms``."""
    both = added.select("terms", F.lit(1).alias("sign")).unionByName(gone.select("terms", F.lit(-1).alias("sign")))
    by_term = exploded(both, ["sign"], F.array_distinct("terms"), "term").groupBy("term").agg(
        F.sum("sign").alias("rows")).where("rows <> 0")
    total = both.agg(F.sum("sign").alias("rows"),
                     F.sum(F.when(F.col("terms").isNotNull(), F.col("sign"))).alias("sized"),
                     F.sum(F.col("sign") * F.size("terms")).alias("words"))
    (by_term.unionByName(total, allowMissingColumns=True)
        .selectExpr("term", "rows", "sized", "words").write.mode("overwrite").parquet(f"{_deltas(path)}/batch_id={batch_id}"))


def index_diff(current: DataFrame, source: DataFrame, deletes: bool = True) -> DataFrame:
    """``id, op`` with op insert, update or delete; unchanged rows do not appear.

    Both sides are ``id, content_hash``: only these two narrow columns are shuffled.  Without
    deletes the source is a small part, and the state is cut to its ids first: Spark broadcasts
    these while they are few, and then the state is not shuffled at all.
    """
    new = source.select("id", F.col("content_hash").alias("new_hash"))
    old = current.select("id", F.col("content_hash").alias("old_hash"))
    if not deletes:
        old = old.join(new.select("id"), "id", "left_semi")
    both = new.join(old, "id", "full" if deletes else "left")
    op = (
        F.when(F.col("old_hash").isNull(), "insert")
        .when(F.col("new_hash").isNull(), "delete")
        .when(F.col("old_hash") != F.col("new_hash"), "update")
    )
    return both.select("id", op.alias("op")).where("op is not null")


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", content_hash("url", "content"))


def _log(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCHEMA)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def current_rows(spark: SparkSession, path: str, before: int | None = None,
                 columns: tuple[str, ...] = ("id", "url", "content", "content_hash", "text_hash",
                                             "terms", "embedding")) -> DataFrame:
    """Latest state of each id, without deleted ones; ``before`` hides that sync and later ones.

    A row is superseded if a later sync updates or deletes its id.  Those keys lie in folders
    of their own, so Spark knows their size and broadcasts them while they are few; ``compact``
    makes them few again.  The wide rows are not grouped, sorted or shuffled (`named`).
    """
    rows = _log(spark, path, before).where("op <> 'delete'")
    if not WIDE & set(columns):
        return _newest(spark, path, before).select(*columns)
    syncs = _log(spark, path, before).select("batch_id").distinct().limit(2).count()
    if syncs > 1:
        rows = named(rows, ["id", "batch_id"], _newest(spark, path, before))
    return rows.select(*columns)


# Columns that hold a text or a list.
WIDE = {"content", "terms", "embedding"}


def _newest(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    rows = _log(spark, path, before).where("op <> 'delete'")
    later = _log(spark, path, before).where("op <> 'insert'").select(
        F.col("id").alias("later_id"), F.col("batch_id").alias("later_batch"))
    return rows.join(
        later, (F.col("id") == F.col("later_id")) & (F.col("batch_id") < F.col("later_batch")),
        "left_anti")


# In place of the content hash of a row whose embedding failed: it differs from every hash.
NO_VECTOR = ""


def next_batch(spark: SparkSession, path: str) -> int:
    """The number after that of the last sync."""
    # The folders' names hold it, so no file is opened for the passages.
    last = _log(spark, path, None).select("batch_id").distinct().agg(F.max("batch_id")).first()[0]
    return 0 if last is None else last + 1


def failed_rows(spark: SparkSession, path: str) -> DataFrame:
    """``id, url, content`` of the rows whose embedding failed; each sync of them tries again."""
    rows = current_rows(spark, path, columns=("id", "url", "content", "content_hash"))
    return rows.where(F.col("content_hash") == NO_VECTOR).drop("content_hash")


def sync_index(chunks: DataFrame, path: str, batch_id: int | None = None, params: Params = Params(),
               embedder=None, deletes: bool = True) -> DataFrame:
    """Bring the index to the state of ``chunks(id, url, content, …)`` and report ``op, rows``.

    Embeds changed rows only.  With ``deletes=False`` the chunks are a part of the source, so
    absent ids stay.  A row whose embedding fails is kept without a vector (`failed_rows`) and is
    a change again next time.  ``batch_id`` is the sync's number, by default the next one; the
    number of an earlier sync replaces that and hides later ones from it.
    """
    spark = chunks.sparkSession
    batch_id = next_batch(spark, path) if batch_id is None else batch_id
    # Read by the comparison and by the wide join, so whatever makes the chunks runs once.
    folder = run_dir(spark, "sync")
    source = staged(with_hash(chunks.select("id", "url", "content")), "source", folder, True)
    current = current_rows(spark, path, batch_id, ("id", "content_hash"))
    # Written once, so that the wide join below does not repeat the comparison.
    changes = staged(index_diff(current, source, deletes), "changes", folder)
    refuse_conflicts(changes.withColumn("content", F.lit("")))  # a repeated id is a repeated change
    coming = changes.where("op <> 'delete'")
    if coming.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        coming = source.join(F.broadcast(coming), "id")
    else:  # mostly the whole source, so that those left out are few
        coming = reduce(DataFrame.unionByName, (
            named(source, ["id"], changes.where(F.col("op") == op)).withColumn("op", F.lit(op)) for op in ("insert", "update")))
    fresh = searchable(coming, params, embedder)
    if embedder is not None:
        fresh = fresh.withColumn("content_hash", F.when(F.col("error").isNull(), F.col("content_hash"))
                                 .otherwise(NO_VECTOR))
    names = ["id", "url", "content", "content_hash", "text_hash", "terms", "embedding", "op"]
    gone = changes.where("op = 'delete'")
    (fresh.select(names).unionByName(gone, allowMissingColumns=True)
        .write.mode("overwrite").options(**SMALL).partitionBy("op").parquet(f"{path}/batch_id={batch_id}"))
    written = spark.read.schema(SCHEMA).parquet(path).where(F.col("batch_id") == batch_id)
    old = changes.where("op <> 'insert'").select("id")
    former = _log(spark, path, batch_id).where("op <> 'delete'")
    if old.take(1):
        former = named(former, ["id", "batch_id"], _newest(spark, path, batch_id).join(old, "id", "left_semi"))
    else:
        former = former.limit(0)
    _write_deltas(written.where("op <> 'delete'"), former.select("id", "terms"), path, batch_id)
    forget(spark, folder)
    return written.groupBy("op").agg(F.count(F.lit(1)).alias("rows"))


def compact(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Rewrite the latest state as the first sync of a new folder, to be used from then on."""
    rows = current_rows(spark, path).withColumn("op", F.lit("insert"))
    rows.write.mode("overwrite").options(**SMALL).partitionBy("op").parquet(f"{target}/batch_id=0")
    now = current_rows(spark, target, columns=("terms",))
    _write_deltas(now, now.limit(0), target, 0)
    return current_rows(spark, target)
