"""Gapless numbers for the rows of a table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quaero.sources.workdir import run_dir, staged


def dense_numbers(df: DataFrame, order: list[Column | str], name: str = "number", start: int = 0,
                  folder: str | None = None) -> DataFrame:
    """``df`` with ``name`` = start, start + 1, … in the order of ``order``.

    One range shuffle and no global sort in one place: each partition numbers its own rows, and the
    partitions' sizes, one row each, give their offsets.  ``order`` should be total, or equal rows
    change places between runs.  The numbers are fixed by writing the table.
    """
    folder = folder or run_dir(df.sparkSession, "numbered")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumns({"_part": F.spark_partition_id(), "_at": within}), "placed", folder)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_at") + F.col("_before") + F.lit(start)).drop("_part", "_at", "_before")
