"""Change detection by digests of id ranges: only ranges that differ are compared row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quaero.plans.index import index_diff
from quaero.sources.workdir import run_dir, staged


def with_range(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("range", F.floor(F.col("id") / F.lit(width)).cast("bigint"))


def range_digests(rows: DataFrame, width: int) -> DataFrame:
    """``range, rows, total, mixed`` of ``rows(id, content_hash)``; partial sums come before the shuffle.

    Both are sums over the rows, so what a sync adds and takes away changes them by as much:
    digests of the state are kept up by adding the digests of the changes.
    """
    h = F.xxhash64("id", "content_hash")
    return with_range(rows, width).groupBy("range").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(20, 0)")).alias("total"), F.bit_xor(h).alias("mixed"))


def differing_ranges(current: DataFrame, source: DataFrame) -> DataFrame:
    """The ranges whose digests are not the same on both sides."""
    names = ("rows", "total", "mixed")
    old = current.select("range", *[F.col(c).alias(f"o_{c}") for c in names])
    both = source.join(old, "range", "full")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    return both.where(~same).select("range")


def range_diff(current: DataFrame, stored: DataFrame, source: DataFrame, width: int, deletes: bool = True) -> DataFrame:
    """The result of `index_diff`, with only the rows of differing ranges compared.

    ``stored`` are the digests of ``current`` from its last sync.  The source is read once for its
    digests; the state is read for the ranges that differ, and no other row of it is shuffled.
    """
    folder = run_dir(current.sparkSession, "ranges")
    ranges = staged(differing_ranges(stored, range_digests(source, width)), "ranges", folder)
    cut = lambda rows: with_range(rows.select("id", "content_hash"), width).join(ranges, "range", "left_semi").drop("range")
    return index_diff(cut(current), cut(source), deletes)
