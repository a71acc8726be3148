"""Keyword search over posting blocks that need not all be read.

Rows are cut into parts, parts into shards.  A block holds the postings of one term in one shard, with
its largest impact.  A search reads the blocks' headers first, ``term, shard, most``: their weighted sum
bounds every score in a shard.  The best shards of each query are scored; then only shards whose bound
reaches the k-th score of some query are read.  Blocks are written many to a row, a page, as most hold
one or two postings.  Pages lie in a folder per part, sorted by term, so both reads are cut to folders
and to row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quaero.operators.scoring import Best, TermKernel
from quaero.operators.topk import fits_broadcast, merged_topk, rank_within, top_k
from quaero.params import Params
from quaero.sources.workdir import run_dir, staged

BLOCKS = "part long, shard int, term string, most double, ids array<long>, impacts array<double>"
# ``first`` and ``last`` are the bounds of ``terms``.  ``blocks`` counts the blocks of each term; ``shards``,
# ``most`` and ``sizes`` have an element a block, ``ids`` and ``impacts`` one a posting.
PAGES = ("part long, first string, last string, terms array<string>, blocks array<int>, shards array<int>, "
         "most array<double>, sizes array<int>, ids array<long>, impacts array<double>")
_HEADS = "part long, codes array<int>, shards array<int>, most array<double>"
_PICKED = "part long, codes array<int>, ids array<long>, impacts array<double>"
# Bounds and scores add the same numbers in another order, and scores are rounded to four digits.
_SLACK = 1e-4


@dataclass(frozen=True)
class Postings:
    """Pages of blocks ``part, shard, term, most, ids, impacts`` under ``path``."""

    path: str
    kernel: TermKernel
    params: Params

    def pages(self, spark) -> DataFrame:
        return spark.read.schema(PAGES).option("basePath", self.path).parquet(self.path)

    def blocks(self, spark) -> DataFrame:
        """One row a block."""
        return self.pages(spark).mapInArrow(_single, BLOCKS)


def build_postings(rows: DataFrame, avg_len: float, params: Params = Params(), path: str | None = None) -> Postings:
    """Write the postings of ``rows(id, terms, …)``; rows of one url lie together, as they share words.

    One shuffle, of the rows by place.  A task cuts its rows into parts and shards of its own, each of
    which holds up to ``shard_rows`` rows whatever the words are, so a word in every row makes no hot spot.
    """
    path = path or run_dir(rows.sparkSession, "postings")
    near = [c for c in ("url",) if c in rows.columns]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = (
        rows.select("id", "terms", *near).where(F.size("terms") > 0)
        .repartitionByRange(*near, "id").sortWithinPartitions(*near, "id")
        .select("id", "terms", F.spark_partition_id().cast("bigint").alias("task"), place.alias("place"))
        .select("id", "terms", F.expr(f"shiftleft(task, 32) + place div {params.part_rows}").alias("part"),
                F.expr(f"cast((place % {params.part_rows}) div {params.shard_rows} AS int)").alias("shard")))
    kernel = TermKernel(avg_len, params.bm25_k1, params.bm25_b)

    def pages(batches):
        for some in _runs(batches, params.run_terms):
            yield _paged(some, kernel, params.page_postings)

    (placed.mapInArrow(pages, PAGES).sortWithinPartitions("part", "first").write.mode("overwrite")
        .option("parquet.block.size", params.posting_group_bytes)
        .option("parquet.page.row.count.limit", params.posting_skip_rows).partitionBy("part").parquet(path))
    return Postings(path, kernel, params)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal neighbours begin, and the end of the last."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(keys[0])])) if len(keys[0]) else np.zeros(1, np.int64)


def _runs(batches, terms: int):
    """Rows sorted by part and shard as tables of whole shards of one part, with about ``terms`` terms at most."""
    held, last, many = [], None, 0
    for batch in batches:
        part, shard = (batch.column(c).to_numpy() for c in ("part", "shard"))
        cuts = _cuts(part, shard)
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = part[a], shard[a]
            if held and key != last and (key[0] != last[0] or many >= terms):
                yield pa.Table.from_batches(held)
                held, many = [], 0
            held.append(batch.slice(a, b - a))
            last, many = key, many + len(held[-1].column("terms").flatten())
    if held:
        yield pa.Table.from_batches(held)


def _list(values, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values) if isinstance(values, np.ndarray) else values)


def _paged(rows: pa.Table, kernel: TermKernel, postings: int) -> pa.RecordBatch:
    """The blocks of rows of one part, in pages of about so many ``postings``."""
    lists = rows["terms"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.take(pc.sort_indices(coded.dictionary))
    code = pc.index_in(coded.dictionary, value_set=names).to_numpy()[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(lists)), lengths)
    pairs, tf = np.unique(code.astype(np.int64) * len(lists) + row, return_counts=True)
    term, row = np.divmod(pairs, len(lists))
    impact = kernel.impact(tf, lengths[row])
    shard = rows["shard"].to_numpy()[row]
    block = _cuts(term, shard)  # where the blocks begin among the postings
    term, shard = term[block[:-1]], shard[block[:-1]]
    number = block[:-1] // postings
    page, word = _cuts(number), _cuts(number, term)  # where pages and their terms begin among the blocks
    of_word = np.searchsorted(word, page)
    return pa.RecordBatch.from_arrays(
        [pa.array([rows["part"][0].as_py()] * (len(page) - 1), pa.int64()),
         names.take(pa.array(term[page[:-1]])), names.take(pa.array(term[page[1:] - 1])),
         _list(names.take(pa.array(term[word[:-1]])), of_word), _list(np.diff(word).astype(np.int32), of_word),
         _list(shard, page), _list(np.maximum.reduceat(impact, block[:-1]), page), _list(np.diff(block).astype(np.int32), page),
         _list(rows["id"].combine_chunks().take(pa.array(row)), block[page]), _list(impact, block[page])],
        names=["part", "first", "last", "terms", "blocks", "shards", "most", "sizes", "ids", "impacts"])


def _single(batches):
    """Pages as single blocks."""
    for batch in batches:
        flat = {c: batch.column(c).flatten() for c in ("terms", "blocks", "shards", "most", "sizes", "ids", "impacts")}
        of = lambda names, times: names.take(pa.array(np.repeat(np.arange(len(names)), times)))
        ends = np.append(0, np.cumsum(flat["sizes"].to_numpy()))
        yield pa.RecordBatch.from_arrays(
            [of(batch.column("part"), pc.list_value_length(batch.column("shards")).to_numpy()), flat["shards"],
             of(flat["terms"], flat["blocks"].to_numpy()), flat["most"], _list(flat["ids"], ends), _list(flat["impacts"], ends)],
            names=["part", "shard", "term", "most", "ids", "impacts"])


class _Asked:
    """The queries by term: which ask for it, with which weight.  A term's code is its place in ``words``."""

    def __init__(self, queries: pa.Table):
        lists = queries["terms"].combine_chunks()
        flat = lists.flatten()
        self.words = flat.unique().take(pc.sort_indices(flat.unique()))
        query = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        weight = queries["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        code = pc.index_in(flat, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.query, self.weight = query[order], weight[order]
        self.cuts = np.searchsorted(code[order], np.arange(len(self.words) + 1))
        self.ids = queries["query_id"].combine_chunks()

    def blocks(self, batch) -> tuple[np.ndarray, ...]:
        """The blocks of pages that some query asks for: their pages, codes, shards and places."""
        code = pc.fill_null(pc.index_in(batch.column("terms").flatten(), value_set=self.words), -1).to_numpy()
        code = np.repeat(code, batch.column("blocks").flatten().to_numpy())
        shards = batch.column("shards")
        page = np.repeat(np.arange(batch.num_rows), pc.list_value_length(shards).to_numpy())
        block = np.flatnonzero(code >= 0)
        return page[block], code[block], shards.flatten().to_numpy()[block], block

    def add(self, out: np.ndarray, code: np.ndarray, at: np.ndarray, value: np.ndarray, first: int = 0) -> None:
        """Adds the weighted values to columns ``at`` of the queries first … first + len(out) - 1; sorted by code."""
        cuts = _cuts(code)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i, j = self.cuts[code[a]], self.cuts[code[a] + 1]
            if first or len(out) < len(self.ids):
                i, j = i + np.searchsorted(self.query[i:j], (first, first + len(out)))
            out[np.ix_(self.query[i:j] - first, at[a:b])] += np.outer(self.weight[i:j], value[a:b])


def _parts(batches):
    """Rows sorted by part as one table for each part."""
    held, last = [], None
    for batch in batches:
        at = batch.column("part").to_numpy() if batch.num_rows else np.empty(0)
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and at[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = at[a]
    if held:
        yield pa.Table.from_batches(held)


def _flat(part: pa.Table, *names: str) -> list[np.ndarray]:
    return [part[c].combine_chunks().flatten().to_numpy() for c in names]


def _heads(shared):
    """The headers of the blocks that some query asks for, a row for each page that has any."""

    def run(batches):
        asked = shared.value
        for batch in batches:
            page, code, shard, block = asked.blocks(batch)
            if len(block):
                cuts = _cuts(page)
                most = batch.column("most").flatten().to_numpy()[block]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take(pa.array(page[cuts[:-1]])), _list(code, cuts), _list(shard, cuts), _list(most, cuts)],
                    names=["part", "codes", "shards", "most"])

    return run


def _picked(shared, p: Params):
    """The postings of the blocks that some query asks for in the shards that are ``wanted`` of each part."""

    def run(batches):
        asked, shards = shared.value, _shards_per_part(p)
        for batch in batches:
            page, code, shard, block = asked.blocks(batch)
            wanted = np.zeros((batch.num_rows, shards), bool)
            lists = batch.column("wanted")
            wanted[np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()] = True
            here = wanted[page, shard]
            page, code, block = page[here], code[here], block[here]
            if len(block):
                size = batch.column("sizes").flatten().to_numpy()
                start, size = (np.cumsum(size) - size)[block], size[block]
                cuts = _cuts(np.repeat(page, size))
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take(pa.array(page[_cuts(page)[:-1]])), _list(np.repeat(code, size), cuts),
                     *(_list(batch.column(c).flatten().take(pa.array(at)), cuts) for c in ("ids", "impacts"))],
                    names=["part", "codes", "ids", "impacts"])

    return run


def _bounds(part: pa.Table, asked: _Asked, shards: int, first: int, last: int) -> np.ndarray:
    """Largest possible score of queries first … last - 1 in each shard of a part."""
    out = np.zeros((last - first, shards))
    code, place, most = _flat(part, "codes", "shards", "most")
    order = np.argsort(code, kind="stable")
    asked.add(out, code[order], place[order], most[order], first)
    return out


def _shards_per_part(p: Params) -> int:
    return -(-p.part_rows // p.shard_rows)


def _seeds(shared, p: Params):
    """The shards with the best bounds of each query among the parts of a task: ``query, part, shard, bound``."""

    def run(batches):
        asked, shards = shared.value, _shards_per_part(p)
        n = len(asked.ids)
        best = np.full((n, p.seed_shards), -1.0)
        where = np.zeros((n, p.seed_shards, 2), np.int64)
        tile = max(1, p.tile_cells // shards)
        for part in _parts(batches):
            number = part["part"][0].as_py()
            for a in range(0, n, tile):
                b = min(n, a + tile)
                both = np.concatenate((best[a:b], _bounds(part, asked, shards, a, b)), axis=1)
                places = np.empty((b - a, shards, 2), np.int64)
                places[..., 0], places[..., 1] = number, np.arange(shards)
                places = np.concatenate((where[a:b], places), axis=1)
                top = np.argsort(-both, axis=1, kind="stable")[:, :p.seed_shards]
                best[a:b] = np.take_along_axis(both, top, axis=1)
                where[a:b] = np.take_along_axis(places, top[..., None], axis=1)
        q, i = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(where[q, i, 0]), pa.array(where[q, i, 1].astype(np.int32)), pa.array(best[q, i])],
            names=["query", "part", "shard", "bound"])

    return run


def _reaching(shared, floors, p: Params):
    """The shards in which some query may still have a hit: ``part, shard``."""

    def run(batches):
        asked, shards, floor = shared.value, _shards_per_part(p), floors.value
        tile = max(1, p.tile_cells // shards)
        for part in _parts(batches):
            some = np.zeros(shards, bool)
            for a in range(0, len(floor), tile):
                bound = _bounds(part, asked, shards, a, min(len(floor), a + tile))
                some |= ((bound > 0) & (bound >= floor[a:a + tile, None] - _SLACK)).any(axis=0)
            at = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array([part["part"][0].as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32))],
                                             names=["part", "shard"])

    return run


def _score(shared, floors, k: int, digits: int, p: Params):
    """The best hits of each query in the shards that are read: ``query_id, id, score``."""

    def run(batches):
        asked = shared.value
        n = len(asked.ids)
        best = Best(n, k, None)
        best.floor = floors.value.copy() if floors is not None else best.floor
        step = max(64, p.tile_cells // max(1, n))
        for part in _parts(batches):
            code, ids, impact = _flat(part, "codes", "ids", "impacts")
            ids, row = np.unique(ids, return_inverse=True)
            order = np.lexsort((code, row // step))
            code, row, impact = code[order], row[order], impact[order]
            cuts = np.searchsorted(row // step, np.arange(-(-len(ids) // step) + 1))
            for tile, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                at = tile * step
                score = np.zeros((n, min(step, len(ids) - at)))
                asked.add(score, code[a:b], row[a:b] - at, impact[a:b])
                best.add(ids[at:at + step], np.where(score > 0, np.round(score, digits), -np.inf))
        yield best.batch(asked.ids)

    return run


@dataclass(frozen=True)
class Found:
    """Hits, and how many shards were read of how many that hold a word of the queries."""

    hits: DataFrame
    read: int
    shards: int


def postings_search(postings: Postings, queries: DataFrame, k: int) -> Found:
    """Exact BM25 top-k of ``queries(query_id, terms, weights)``: ``query_id, id, score, rank``.

    The caller has checked that the queries are small enough to broadcast.
    """
    p = postings.params
    spark = queries.sparkSession
    folder = run_dir(spark, "search")
    table = queries.select("query_id", "terms", "weights").toArrow()
    asked = _Asked(table)
    shared = spark.sparkContext.broadcast(asked)
    pages = postings.pages(spark)
    if len(asked.words) <= p.pushed_terms:  # reaches the row groups' statistics
        named = F.lit(False)
        for t in asked.words.to_pylist():
            named = named | ((F.col("first") <= t) & (F.col("last") >= t))
        pages = pages.where(named)
    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    heads = staged(pages.select("part", "terms", "blocks", "shards", "most").mapInArrow(_heads(shared), _HEADS), "heads", folder)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id bigint, score double"

    def hits(shards: DataFrame, floors) -> DataFrame:
        # The parts are named, so that other folders are not listed; a part is a folder.
        wanted = shards.groupBy("part").agg(F.collect_list("shard").alias("wanted"))
        some = pages.join(F.broadcast(wanted), "part").select(
            "part", "wanted", "terms", "blocks", "shards", "sizes", "ids", "impacts")
        return by_part(some.mapInArrow(_picked(shared, p), _PICKED)).mapInArrow(
            _score(shared, floors, k, postings.kernel.digits, p), schema)

    seeds = rank_within(by_part(heads).mapInArrow(_seeds(shared, p), "query long, part long, shard int, bound double"),
                        "query", [F.desc("bound"), F.asc("part"), F.asc("shard")]).where(F.col("rank") <= p.seed_shards)
    seeds = staged(seeds.select("part", "shard").distinct(), "seeds", folder)
    first = staged(top_k(hits(seeds, None), k), "first", folder)
    kth = {r.query_id: r.score for r in first.where(F.col("rank") == k).collect()}  # one row a query
    floor = np.array([kth.get(q, -np.inf) for q in asked.ids.to_pylist()])
    floors = spark.sparkContext.broadcast(floor)
    reaching = by_part(heads).mapInArrow(_reaching(shared, floors, p), "part long, shard int")
    more = staged(reaching.join(seeds, ["part", "shard"], "left_anti"), "more", folder)
    held = heads.select("part", F.explode(F.array_distinct("shards")).alias("shard")).distinct()
    counts = [held.count(), seeds.count(), more.count()]
    merged = merged_topk(first.drop("rank").unionByName(hits(more, floors)), k)
    return Found(merged, counts[1] + counts[2], counts[0])


def postings_topk(postings: Postings, queries: DataFrame, k: int) -> DataFrame | None:
    """The hits of `postings_search`, or None if the queries are too large to broadcast."""
    queries = staged(queries.select("query_id", "terms", "weights"), "asked")
    if not fits_broadcast(queries, postings.kernel, postings.params):
        return None
    return postings_search(postings, queries, k).hits
