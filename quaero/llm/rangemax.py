"""Ranked lexical search by range-maximum queries over posting lists.

Documents form shards of bounded size.  A shard has a posting list per term, with a sparse table
over its impacts, so the largest impact of a term within any interval of documents is two look-ups.
Their sum over the terms of an item bounds every score in the interval.  Intervals are opened best
bound first: the document with the largest impact is scored exactly and splits the interval in two.
An interval whose bound cannot reach the k-th score so far is never opened.

All items of a block take their next intervals together, as one array operation; the k-th scores go
from shard to shard within a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quaero.llm import words
from quaero.sources.workdir import run_dir, staged

# What lies between terms; the weights of the score.
_BETWEEN = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_KIND = words.table(between=_BETWEEN)
_CUT = re.compile("[" + re.escape(_BETWEEN.decode()) + "]")


@dataclass(frozen=True)
class RankParams:
    best: int = 10                # documents for an item
    shard: int = 8192             # documents of one set of posting lists
    wave: int = 16                # intervals that an item opens at a time
    block_chars: int = 2 << 20    # of items searched in one pass over the documents


def _terms(texts: list[str]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(number of the text of each term, the terms) for parts of the texts."""
    for bundle in words.bundles(texts, _CUT):
        part, found, _ = words.split([f"{p} " for _, p, _ in bundle], _KIND, words.LOWER)
        yield np.array([i for i, _, _ in bundle])[part], found


def _counts(vocabulary: pa.Array):
    """Per document: all its terms with repeats, and the numbers and counts of those in the vocabulary."""

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            found = [np.empty((2, 0), np.int64)]
            for owner, terms in _terms([t or "" for t in batch.column(1).to_pylist()]):
                n += np.bincount(owner, minlength=len(n))
                number = pc.index_in(terms, value_set=vocabulary.value)
                hit = number.is_valid().to_numpy(zero_copy_only=False)
                pairs = np.stack((owner[hit], number.drop_null().to_numpy().astype(np.int64)))
                found.append(pairs)
            owner, number = np.concatenate(found, axis=1)
            key, tf = np.unique(owner * max(1, len(vocabulary.value)) + number, return_counts=True)
            owner, number = np.divmod(key, max(1, len(vocabulary.value)))
            ends = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(number.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], names=["doc", "n", "terms", "tf"])

    return run


class Postings:
    """The posting lists of a shard, end to end, with sparse tables over their impacts."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, size: int):
        order = np.lexsort((place, term))
        self.size = size
        self.place, self.impact = place[order], impact[order]
        self.key = term[order].astype(np.int64) * (size + 1) + self.place
        longest = int(np.bincount(term).max(initial=1)) if len(term) else 1
        # table[j][i]: where the largest impact of the postings i … i + 2**j - 1 is
        self.table = [np.arange(len(term), dtype=np.int32)]
        for j in range(longest.bit_length() - 1):
            a = self.table[-1][:-(1 << j)]
            b = self.table[-1][1 << j:]
            best = np.where(self.impact[a] >= self.impact[b], a, b)
            self.table.append(np.concatenate((best, np.zeros(len(term) - len(best), np.int32))))
        self.flat = np.concatenate(self.table)

    def largest(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest impact of the term in documents lo … hi - 1, the document); 0 where it has none there."""
        a = np.searchsorted(self.key, term * (self.size + 1) + lo)
        b = np.searchsorted(self.key, term * (self.size + 1) + hi)
        out, at = np.zeros(len(term), np.int64), np.zeros(len(term), np.int64)
        some = np.flatnonzero(a < b)
        a, b = a[some], b[some]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        row = level.astype(np.int64) * len(self.key)
        left = self.flat[row + a]
        right = self.flat[row + b - (np.int64(1) << level)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        out[some], at[some] = self.impact[best], self.place[best]
        return out, at

    def impacts(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impact of the term in the document; 0 if the document lacks it."""
        key = term * (self.size + 1) + doc
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        return np.where(self.key[at] == key, self.impact[at], 0)


class Items:
    """The distinct terms of each item, end to end."""

    def __init__(self, terms: list[np.ndarray]):
        self.count = np.array([len(t) for t in terms], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.terms = np.concatenate(terms) if terms else np.empty(0, np.int64)

    def spread(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each of the items, which of them each is of, where each one's terms start)."""
        count = self.count[item]
        start = np.cumsum(count) - count
        of = np.repeat(np.arange(len(item)), count)
        return self.terms[self.first[item][of] + np.arange(len(of)) - start[of]], of, start


def _ranks(item: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its item, in an array sorted by item."""
    return np.arange(len(item)) - np.searchsorted(item, item)


def search(postings: Postings, items: Items, floor: np.ndarray, p: RankParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of all documents that may be among the best of an item.

    ``floor`` is the score of the k-th best so far of each item, 0 if there are fewer, and is raised
    here.  Documents as good as the k-th all come, so that the caller may break ties.
    """
    hits = [np.empty(0, np.int64)] * 3

    def bounded(item, lo, hi):
        term, of, start = items.spread(item)
        most, at = postings.largest(term, lo[of], hi[of])
        bound = np.add.reduceat(most, start) if len(most) else np.zeros(0, np.int64)
        top = np.maximum.reduceat(most, start) if len(most) else bound
        first = np.flatnonzero(most == top[of])
        _, pick = np.unique(of[first], return_index=True)
        return item, lo, hi, bound, at[first[pick]] if len(first) else bound

    some = np.flatnonzero(items.count)
    if not len(postings.key) or not len(some):
        return tuple(hits)
    left = bounded(some, np.zeros(len(some), np.int64), np.full(len(some), postings.size))
    while True:
        item, lo, hi, bound, split = left
        live = (bound > 0) & (bound >= floor[item])
        item, lo, hi, bound, split = (x[live] for x in (item, lo, hi, bound, split))
        if not len(item):
            break
        order = np.lexsort((-bound, item))
        item, lo, hi, bound, split = (x[order] for x in (item, lo, hi, bound, split))
        now = _ranks(item) < p.wave
        term, of, start = items.spread(item[now])
        score = np.add.reduceat(postings.impacts(term, split[now][of]), start)
        hits = [np.concatenate(x) for x in zip(hits, (item[now], split[now], score))]
        order = np.lexsort((-hits[2], hits[0]))
        hits = [x[order] for x in hits]
        kth = _ranks(hits[0]) == p.best - 1
        floor[hits[0][kth]] = np.maximum(floor[hits[0][kth]], hits[2][kth])
        good = hits[2] >= floor[hits[0]]
        hits = [x[good] for x in hits]
        halves = [np.concatenate(x) for x in zip((item[now], lo[now], split[now]), (item[now], split[now] + 1, hi[now]))]
        halves = [x[halves[1] < halves[2]] for x in halves]
        left = [np.concatenate(x) for x in zip((item[~now], lo[~now], hi[~now], bound[~now], split[~now]), bounded(*halves))]
    return tuple(hits)


def _weights(df: np.ndarray, total: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _search(shared, p: RankParams, kind: pa.DataType):
    """Best documents of each item among those of a task."""

    def shard(rows: pa.Table, floor, held):
        items, weight, total, length = shared.value
        n = rows["n"].to_numpy()
        order = np.argsort(n, kind="stable")  # documents of like length together: their impacts are alike
        rows, n = rows.take(pa.array(order)), n[order]
        lists = rows["terms"].combine_chunks()
        place = np.repeat(np.arange(len(n)), pc.list_value_length(lists).to_numpy())
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = rows["tf"].combine_chunks().flatten().to_numpy()
        m = 100 - 90 + (90 * n * total) // length
        impact = weight[term] * ((1000000000 * tf) // (1000 * tf + 8 * m[place]))
        item, doc, score = search(Postings(term, place, impact, len(n)), items, floor, p)
        names = rows["doc"].combine_chunks().take(pa.array(doc)).to_pylist()
        for i, s, name in zip(item.tolist(), score.tolist(), names):
            held.setdefault(i, []).append((-s, name is None, name))
        for i in np.unique(item).tolist():
            held[i] = sorted(held[i])[:p.best]
            if len(held[i]) == p.best:
                floor[i] = max(floor[i], -held[i][-1][0])

    def run(batches):
        floor = np.zeros(len(shared.value[0].count), np.int64)
        held: dict[int, list[tuple]] = {}
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, p.shard - size)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                size += part.num_rows
                if size == p.shard:
                    shard(pa.Table.from_batches(waiting), floor, held)
                    waiting, size = [], 0
        if waiting:
            shard(pa.Table.from_batches(waiting), floor, held)
        rows = [(i, name, -s) for i, found in held.items() for s, _, name in found]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())],
                                         names=["number", "doc", "score"])

    return run


def _ranked(docs: DataFrame, asked: list, p: RankParams, folder: str) -> DataFrame:
    """``number, rank, doc, score`` for the items of a block, ``(number, text)``."""
    context = docs.sparkSession.sparkContext
    named = [sorted({t for _, found in _terms([text]) for t in found.to_pylist()}) for _, text in asked]
    vocabulary = pa.array(sorted(set().union(*named)), pa.large_string())
    kind = docs.schema["doc"].dataType.simpleString()
    rows = docs.mapInArrow(_counts(context.broadcast(vocabulary)), f"doc {kind}, n long, terms array<int>, tf array<long>")
    rows = staged(rows.filter("n > 0"), "counts", folder)
    total, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r.t] = r.df
    number = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    items = Items([np.array([number[t] for t in x], np.int64) for x in named])
    shared = context.broadcast((items, _weights(df, total), total, length))
    found = rows.filter(F.size("terms") > 0).mapInArrow(
        _search(shared, p, to_arrow_type(docs.schema["doc"].dataType)), f"number long, doc {kind}, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return staged(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.best), "ranked", folder)


def rank_documents(docs: DataFrame, items: DataFrame, params: RankParams = RankParams(), key: str = "doc_id",
                   text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, doc, score``: the ``best`` documents with a score above 0 for each item.

    Terms are runs of letters, digits and characters beyond ASCII, A–Z in lower case.  Equal scores
    go by key, nulls last.  A null or empty text has no terms; such documents do not count, and such
    items find nothing.  Items that repeat with key and text are answered once; each repeated
    document is one of its own.  Whole texts are read, long ones part by part.  Items are searched in
    blocks of bounded size, all documents for each.  Empty tables give no row.  Other columns are not
    read.
    """
    p = params
    folder = run_dir(docs.sparkSession, "ranked")
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    asked = staged(asked.withColumn("number", F.monotonically_increasing_id()), "items", folder)
    chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * chars // p.block_chars))
    parts = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("number", "text").collect()
        part = _ranked(docs, [tuple(r) for r in block], p, f"{folder}/{b}")
        numbers = [r.number for r in block]
        # Numbers within the block become those of the items again.
        names = docs.sparkSession.createDataFrame(list(enumerate(numbers)), "number long, _item long")
        part = part.join(names, "number").select(F.col("_item").alias("number"), "rank", "doc", "score")
        parts = part if parts is None else parts.unionByName(part)
    return parts.join(asked.select("number", "item"), "number").select("item", "rank", "doc", "score")
