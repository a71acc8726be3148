"""Joins, groups and components that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quaero.sources.workdir import staged

HEAVY = 1000


def join_counted(rows: DataFrame, keys: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with one row per key that knows how often its key occurs.

    Keys with more than a ``HEAVY``-th of all occurrences are fewer than ``HEAVY``, whatever the
    input, so those are broadcast and their rows stay where they are; only the others are
    shuffled, and none of those is large.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    heavy = F.broadcast(keys.filter(F.col(count) > total // HEAVY))
    light = keys.filter(F.col(count) <= total // HEAVY)
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key))


class Sieve:
    """Which 64-bit hashes may be among those of a table: a bit for each of ``bits`` ranges of them.

    Its size is fixed, so it may be broadcast whatever the table holds.  It lets some others
    through, more as the table grows, and keeps back none of the table's own.
    """

    def __init__(self, rows: pa.Table, bits: int):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.map = np.zeros(bits >> 6, np.uint64)
        self.map[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) >> self.shift
        return (self.map[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def sieve(rows: DataFrame, h: str, bits: int = 1 << 24) -> Sieve:
    """The sieve of the hashes in the column ``h``; at most ``bits / 64`` rows reach the driver."""
    at = F.shiftrightunsigned(h, 64 - (bits.bit_length() - 1)).alias("at")
    slots = rows.select(at).selectExpr("shiftright(at, 6) AS slot", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    return Sieve(slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow(), bits)


def map_groups(rows: DataFrame, key: str, task: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]],
               schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Run ``task`` over the groups of ``key``, many groups to a task, one whole group in memory.

    The caller bounds the size of a group.
    """

    def run(batches):
        return task(_groups(batches, key))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _groups(batches, key) -> Iterator[pa.Table]:
    kept: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        names = table[key].to_pylist()
        start = 0
        if kept and names[0] != last:
            yield pa.concat_tables(kept)
            kept = []
        for i in range(1, len(names)):
            if names[i] != names[i - 1]:
                part = table.slice(start, i - start)
                yield pa.concat_tables([*kept, part]) if kept else part
                kept, start = [], i
        kept.append(table.slice(start))
        last = names[-1]
    if kept:
        yield pa.concat_tables(kept)


def _stars(pairs: DataFrame) -> bool:
    """Whether each ``hi`` has one ``lo`` and none of these has one itself, so that another step would change nothing."""
    ends = pairs.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        pairs.select(F.col("lo").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    tied = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tied.agg(F.coalesce(F.max((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)), F.lit(False))).first()[0] is False


def components(edges: DataFrame, a: str, b: str, folder: str, name: str) -> DataFrame:
    """``node, root``: the smallest node that links lead to, for each node that has a link.

    Alternates large and small stars: each node's neighbours are tied to the smallest of them,
    until every component is one star.  Each step is a written table.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    pairs = staged(edges.select(lo.alias("lo"), hi.alias("hi")).filter("lo < hi").distinct(), f"{name}-0", folder)
    step = 0
    while not _stars(pairs):
        step += 1
        both = pairs.selectExpr("lo AS u", "hi AS v").unionByName(pairs.selectExpr("hi AS u", "lo AS v"))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
                       .withColumn("m", F.least("m", "u")), f"{name}-{step}-a", folder)
        large = staged(join_counted(both, least, "u", "n").filter("v > u AND v > m").select("m", "v").distinct(),
                       f"{name}-{step}-b", folder)
        least = staged(large.groupBy("v").agg(F.min("m").alias("least"), F.count("*").alias("n")),
                       f"{name}-{step}-c", folder)
        tied = join_counted(large, least, "v", "n")
        pairs = staged(
            tied.selectExpr("least AS lo", "v AS hi").unionByName(tied.selectExpr("least AS lo", "m AS hi"))
            .filter("lo < hi").distinct(), f"{name}-{step}", folder)
    return pairs.selectExpr("hi AS node", "lo AS root").unionByName(pairs.selectExpr("lo AS node", "lo AS root").distinct())


def link_report(rows: DataFrame, classes: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """Per row of ``rows`` (row, id, digest): ``id, digest, n_links, class_id, first``.

    ``classes`` has one row per digest (row, digest, copies, first), where first is the struct that
    orders its rows; ``links`` has any number of rows (row, links, root) for the classes that link.
    Copies count as links of each other, and ``first`` marks the first row of each component.
    """
    roots = components(links, "row", "root", folder, "linked").withColumnRenamed("node", "row")
    own = links.groupBy("row").agg(F.sum("links").alias("links"))
    counted = classes.join(own, "row", "left").join(roots, "row", "left")
    counted = staged(counted.select(
        "digest", "copies", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "row").alias("root")), "counted", folder)
    firsts = staged(counted.groupBy("root").agg(F.min("first").alias("best"), F.count("*").alias("n")), "firsts", folder)
    named = staged(join_counted(counted.drop("first"), firsts, "root", "n").select("digest", "copies", "n_links", "best"),
                   "named", folder)
    return join_counted(rows.select("row", "id", "digest"), named, "digest", "copies").select(
        "id", "digest", "n_links", F.col("best.id").alias("class_id"), (F.col("row") == F.col("best.row")).alias("first"))


def first_of() -> Column:
    """What orders the rows of a class: by id, nulls last, then by row."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "row")
