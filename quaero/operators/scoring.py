"""Scoring kernels: one block of queries against one Arrow batch of index rows.

A kernel is a small picklable record of parameters.  ``block`` prepares a set of query rows,
``scores`` returns the (queries x rows) score matrix of one batch.  A score that must never
be a hit is -inf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(col: pa.Array) -> np.ndarray:
    """Equal-length list column to a 2-d float64 array."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and which rows have one; a row without a vector is all zeros."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    has = sizes > 0
    out = np.zeros((len(col), int(sizes.max(initial=0))))
    if has.any():
        out[has] = _unit(_matrix(col.filter(pa.array(has))))
    return out, has


class _Whole:
    """Tiles of a kernel that has a score for every query and row of them."""

    def blocks(self, queries: pa.Table, size: int):
        """What all blocks of ``size`` queries share, and these blocks."""
        return None, [self.block(queries.slice(at, size)) for at in range(0, queries.num_rows, size)]

    def encoded(self, shared, batch):
        """The rows of a batch, made ready once for all blocks."""
        return batch

    def into(self, block, rows, ids: np.ndarray, best: "Best") -> None:
        """Adds the hits of one tile."""
        best.add(ids, self.scores(block, rows))


# Exact scores are made of so many candidates at once.
_PAIRS = 1 << 16


def _products(left: np.ndarray, right: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The products of the named rows of two matrices."""
    out = np.empty(len(q))
    step = max(1, (_PAIRS << 6) // max(1, left.shape[1]))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        out[part] = np.einsum("ij,ij->i", left[q[part]], right[row[part]])
    return out


@dataclass(frozen=True)
class VectorKernel(_Whole):
    """Cosine, by default mapped to [0, 1] by (1 + cos) / 2.

    A tile is multiplied in single precision; the pairs that may pass by that, within the bound of
    its error, are multiplied again in double precision.
    """

    normalised: bool = True
    digits: int = 6

    index_columns = ("embedding",)
    query_columns = ("embedding",)

    def block(self, queries: pa.Table):
        x = _unit(_matrix(queries["embedding"].combine_chunks()))
        return x, x.astype(np.float32)

    def encoded(self, shared, batch):
        x = _unit(_matrix(batch.column("embedding")))
        return x, x.astype(np.float32)

    def into(self, block, rows, ids: np.ndarray, best: "Best") -> None:
        (asked, asked32), (x, x32) = block, rows
        q, row = best.passing(asked32 @ x32.T, self.cosine(best.floor), self.slack(x), 0.0)
        self.taken(asked, x, q, row, ids, best)

    def cosine(self, score):
        return 2.0 * score - 1.0 if self.normalised else score

    def slack(self, x: np.ndarray) -> float:
        """What a product in single precision and the rounding of scores may make of a cosine."""
        return (x.shape[1] + 8) * 2.4e-7 + 2 * 10.0 ** -self.digits

    def taken(self, asked, x, q: np.ndarray, row: np.ndarray, ids: np.ndarray, best: "Best") -> None:
        cos = _products(asked, x, q, row)
        best.merge(q, ids[row], np.round((1.0 + cos) / 2.0 if self.normalised else cos, self.digits))


@dataclass(frozen=True)
class CellKernel(VectorKernel):
    """`VectorKernel` for rows with a cell: a query meets only cells that can hold a row above its floor.

    ``shared`` is a broadcast of the unit centroids and of the largest angle of a row to its own.
    No row of a cell is nearer than the angle to its centroid less that.
    """

    shared: object = None

    index_columns = ("embedding", "cell")
    query_columns = ("embedding", "floor")

    def block(self, queries: pa.Table):
        x, x32 = super().block(queries)
        centroids, reach = self.shared.value
        bound = np.cos(np.maximum(0, np.arccos(np.clip(x @ centroids.T, -1, 1)) - reach)) + 1e-5
        floor = queries["floor"].to_numpy().astype(np.float64)
        return x, x32, (1.0 + bound) / 2.0 if self.normalised else bound, floor

    def encoded(self, shared, batch):
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        return *super().encoded(shared, batch), cell, np.split(order, cuts) if len(order) else []

    def into(self, block, rows, ids: np.ndarray, best: "Best") -> None:
        asked, asked32, bound, floor = block
        x, x32, cell, groups = rows
        best.floor = np.maximum(best.floor, floor)
        cells = [cell[g[0]] for g in groups]
        near = bound[:, cells] >= best.floor[:, None]
        if near.mean() > 0.5:  # most pairs count: one product of the whole tile
            groups, near = [np.arange(len(x))], near.any(axis=1)[:, None]
        for i, group in enumerate(groups):
            at = np.flatnonzero(near[:, i])
            if len(at):
                q, row = best.passing(asked32[at] @ x32[group].T, self.cosine(best.floor[at]), self.slack(x), 0.0)
                self.taken(asked, x, at[q], group[row], ids, best)


class _Matches(_Whole):
    """Sum of weight x impact over the terms that a query and a row have in common."""

    index_columns = ("terms",)
    query_columns = ("terms", "weights")

    def blocks(self, queries: pa.Table, size: int):
        """The words of all queries, and by block the words, weights and queries, sorted by word."""
        lists = queries["terms"].combine_chunks()
        flat = lists.flatten()
        vocab = pc.unique(flat)
        term = pc.index_in(flat, value_set=vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        weight = queries["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes))
        blocks = []
        for at in range(0, len(sizes), size):
            a, b = ends[at], ends[min(at + size, len(sizes))]
            n = sizes[at:at + size]
            order = np.argsort(term[a:b], kind="stable")
            blocks.append((len(n), int(n.max(initial=0)), term[a:b][order], weight[a:b][order], np.repeat(np.arange(len(n)), n)[order]))
        return vocab, blocks

    def encoded(self, vocab, batch):
        """The words of the rows that some query has, with their rows and impacts, sorted by word."""
        lists = batch.column("terms")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        if not len(vocab) or not len(lists):
            return len(lists), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found = pc.index_in(lists.flatten(), value_set=vocab)
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, tf = np.unique(term * len(lists) + np.repeat(np.arange(len(lists)), lengths)[hit], return_counts=True)
        term, row = np.divmod(pairs, len(lists))
        return len(lists), term, row, self.impact(tf, lengths[row])

    def into(self, block, rows, ids: np.ndarray, best: "Best") -> None:
        """Words that many queries and rows of the tile share are multiplied as matrices, in single
        precision, and again in double precision for the pairs that may pass; the others are added pair by pair."""
        n, longest, q_term, weight, query = block
        width, r_term, impact_row, impact = rows
        words = np.intersect1d(q_term, r_term)
        if not len(words):
            return
        qa, qb = np.searchsorted(q_term, words), np.searchsorted(q_term, words, "right")
        ra, rb = np.searchsorted(r_term, words), np.searchsorted(r_term, words, "right")
        many = (qb - qa) * (rb - ra) * 64 >= n * width
        column = np.cumsum(many) - 1
        left, right = np.zeros((n, many.sum())), np.zeros((width, many.sum()))

        def entries(a, b):  # the places a … b - 1 of each word, and the word of each
            size = b - a
            return np.repeat(a - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()), np.repeat(np.arange(len(a)), size)

        at, word = entries(qa[many], qb[many])
        left[query[at], word] = weight[at]
        at, word = entries(ra[many], rb[many])
        right[impact_row[at], word] = impact[at]
        raw = left.astype(np.float32) @ right.astype(np.float32).T
        rest = None
        if not many.all():
            few = ~many
            rest = np.zeros(n * width)
            at, word = entries(qa[few], qb[few])
            held = (rb - ra)[few][word]
            starts = ra[few][word]
            total = np.cumsum(held)
            cut = 0
            while cut < len(at):  # bounds the pairs made at once
                end = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + 16 * _PAIRS)))
                some = held[cut:end]
                place = np.repeat(starts[cut:end] - np.append(0, np.cumsum(some)[:-1]), some) + np.arange(some.sum())
                flat = np.repeat(query[at[cut:end]] * width, some) + impact_row[place]
                np.add.at(rest, flat, np.repeat(weight[at[cut:end]], some) * impact[place])
                cut = end
            rest = rest.reshape(n, width)
            raw += rest
        q, row = best.passing(raw, best.floor, 10.0 ** -self.digits, 3 * (longest + 8) * 1.2e-7, 0.0)
        score = _products(left, right, q, row)
        best.merge(q, ids[row], np.round(score if rest is None else score + rest[q, row], self.digits))

    def block(self, queries: pa.Table):
        lists = queries["terms"].combine_chunks()
        flat = lists.flatten()
        vocab = pc.unique(flat)
        term = pc.index_in(flat, value_set=vocab).to_numpy(zero_copy_only=False)
        weight = queries["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        query = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        order = np.argsort(term, kind="stable")
        ends = np.searchsorted(term[order], np.arange(len(vocab) + 1))
        # Terms that many queries share are scored by one matrix product.
        asked = np.diff(ends)
        shared = np.flatnonzero((asked >= 8) & (asked * 20 >= len(lists)))
        column = np.full(len(vocab), -1)
        column[shared] = np.arange(len(shared))
        dense = np.zeros((len(lists), len(shared)))
        in_dense = column[term] >= 0
        dense[query[in_dense], column[term[in_dense]]] = weight[in_dense]
        return vocab, ends, query[order], weight[order], column, dense

    def raw(self, block, batch) -> np.ndarray:
        vocab, ends, query, weight, column, dense = block
        lists = batch.column("terms")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        if not len(vocab):
            return np.zeros((len(dense), len(lists)))
        found = pc.index_in(lists.flatten(), value_set=vocab)
        rows = np.repeat(np.arange(len(lists)), lengths)
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, tf = np.unique(term * len(lists) + rows[hit], return_counts=True)
        term, row = np.divmod(pairs, len(lists))
        impact = self.impact(tf, lengths[row])
        many = column[term] >= 0
        shared = np.zeros((dense.shape[1], len(lists)))
        shared[column[term[many]], row[many]] = impact[many]
        out = dense @ shared
        term, row, impact = term[~many], row[~many], impact[~many]
        cuts = np.flatnonzero(np.diff(term)) + 1
        for at, end in zip(np.r_[0, cuts], np.r_[cuts, len(term)]):
            if end > at:
                qs = slice(ends[term[at]], ends[term[at] + 1])
                # A query names a term once, so no cell is addressed twice here.
                out[np.ix_(query[qs], row[at:end])] += np.outer(weight[qs], impact[at:end])
        return out


@dataclass(frozen=True)
class TermKernel(_Matches):
    """BM25: the impact is tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length))."""

    avg_len: float
    k1: float
    b: float
    digits: int = 4

    def impact(self, tf, length):
        norm = self.k1 * (1.0 - self.b + self.b * length / self.avg_len)
        return tf * (self.k1 + 1.0) / (tf + norm)


# So many terms are compared at once.
_STRIDE = 1024


@dataclass(frozen=True)
class ShareKernel(_Whole):
    """Share of a query's distinct terms, given as numbers, that a row holds, however often.

    A query's ``floor`` is a score that some row is known to reach.  Terms are compared ``_STRIDE`` at a
    time, first those that most queries have and most rows lack; a pair that then lacks more of the
    query's terms than its floor allows goes no further.  Counts are whole numbers, so none is inexact.
    """

    digits: int = 4

    index_columns = ("terms",)
    query_columns = ("terms", "floor")

    def blocks(self, queries: pa.Table, size: int):
        lists = queries["terms"].combine_chunks()
        flat = lists.flatten()
        vocab = pc.unique(flat)
        term = pc.index_in(flat, value_set=vocab).to_numpy(zero_copy_only=False).astype(np.int32)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes))
        floor = queries["floor"].to_numpy().astype(np.float64)
        shared = {"vocab": vocab, "asked": np.bincount(term, minlength=len(vocab))}
        blocks = []
        for at in range(0, len(sizes), size):
            n = sizes[at:at + size]
            some = slice(ends[at], ends[at + len(n)])
            each, of = np.unique(n, return_inverse=True)
            # By the number of common terms; summed one by one, as rounding tells sums apart from quotients.
            scores = [np.round(np.append(0.0, np.cumsum(np.full(m, 1.0 / max(1, m)))), self.digits) for m in each]
            first = np.append(0, np.cumsum([len(x) for x in scores]))[of]
            blocks.append({"n": n, "floor": floor[at:at + size], "term": term[some], "scores": np.concatenate(scores), "first": first,
                           "query": np.repeat(np.arange(len(n), dtype=np.int32), n)})
        return shared, blocks

    def encoded(self, shared, batch):
        """The places of the tile's terms in the order of comparison, and its rows by stride."""
        lists = batch.column("terms")
        found = pc.index_in(lists.flatten(), value_set=shared["vocab"])
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists), dtype=np.int32), lengths)[hit]
        term = found.drop_null().to_numpy(zero_copy_only=False)
        if "place" not in shared:  # by the first tile; any order gives the same hits
            held = np.bincount(term, minlength=len(shared["vocab"])) / max(1, len(lists))
            order = np.argsort(-shared["asked"] * (1.0 - np.minimum(held, 1.0)), kind="stable")
            shared["place"] = np.empty(len(order), np.int32)
            shared["place"][order] = np.arange(len(order), dtype=np.int32)
        return {"n": len(lists), "strides": -(-len(shared["vocab"]) // _STRIDE), "place": shared["place"],
                **self._by_stride(shared["place"][term], row)}

    @staticmethod
    def _by_stride(place: np.ndarray, row: np.ndarray) -> dict:
        order = np.argsort(place // _STRIDE, kind="stable")
        place, row = place[order], row[order]
        return {"at": place, "row": row, "dense": {}}

    @staticmethod
    def _matrix(side: dict, stride: int, cached: bool) -> np.ndarray:
        """Which rows of a side have which terms of a stride, as zeros and ones."""
        if stride in side["dense"]:
            return side["dense"][stride]
        a, b = np.searchsorted(side["at"] // _STRIDE, (stride, stride + 1))
        out = np.zeros((side["n"], _STRIDE), np.float32)
        out[side["row"][a:b], side["at"][a:b] - stride * _STRIDE] = 1.0
        if cached:
            side["dense"][stride] = out
        return out

    def into(self, block, rows, ids: np.ndarray, best: "Best") -> None:
        if "side" not in block:
            block["side"] = {**self._by_stride(rows["place"][block["term"]], block["query"]), "n": len(block["n"])}
        best.floor = np.maximum(best.floor, block["floor"])
        side, size = block["side"], block["n"].astype(np.float64)
        # What a query may lack; a score is rounded, so that it may be reached from below.
        lost = size - size * (best.floor - 0.6 * 10.0 ** -self.digits)
        asked, common = np.zeros(len(size)), np.zeros((len(size), rows["n"]), np.float32)
        q = None
        for stride in range(rows["strides"]):
            left, right = (self._matrix(x, stride, stride == 0) for x in (side, rows))
            asked += left.sum(axis=1, dtype=np.float64)
            if q is None:
                common += left @ right.T
                alive = common >= (asked - lost).astype(np.float32)[:, None] - 0.5
                if np.count_nonzero(alive) * 32 <= alive.size:
                    q, row = np.nonzero(alive)
                    count = common[q, row].astype(np.float64)
            elif len(q):
                bits = [np.packbits(x.astype(bool), axis=1).view(np.uint64) for x in (left, right)]
                for at in range(0, len(q), _PAIRS):
                    part = slice(at, at + _PAIRS)
                    count[part] += np.bitwise_count(bits[0][q[part]] & bits[1][row[part]]).sum(axis=1)
                some = count >= (asked - lost)[q] - 0.5
                q, row, count = q[some], row[some], count[some]
        if q is None:
            best.add(ids, np.where(common > 0, block["scores"][block["first"][:, None] + common.astype(np.int64)], -np.inf))
        else:
            q, row, count = q[count > 0], row[count > 0], count[count > 0].astype(np.int64)
            best.merge(q, ids[row], block["scores"][block["first"][q] + count])


@dataclass(frozen=True)
class BlendKernel(_Whole):
    """Linear fusion: w * (1 + cos) / 2 + (1 - w) * bm25 / best bm25 of the query.

    Where the row or the query has no vector, only the words count; a row that shares neither a
    vector nor a word with the query is no hit.
    """

    terms: TermKernel
    weight: float
    digits: int = 4

    index_columns = ("embedding", "terms")
    query_columns = ("embedding", "terms", "weights", "best")

    def block(self, queries: pa.Table):
        best = queries["best"].to_numpy().astype(np.float64)
        return (_vectors(queries["embedding"].combine_chunks()), self.terms.block(queries),
                np.divide(1.0, best, out=np.zeros_like(best), where=best > 0)[:, None])

    def scores(self, block, batch) -> np.ndarray:
        (asked, has_asked), terms, scale = block
        rows, has_row = _vectors(batch.column("embedding"))
        both = has_asked[:, None] & has_row[None, :]
        cos = np.zeros(both.shape)
        if both.any():
            cos = np.where(both, (1.0 + asked @ rows.T) / 2.0, 0.0)
        lexical = self.terms.raw(terms, batch) * scale
        blended = np.round(self.weight * cos + (1.0 - self.weight) * lexical, self.digits)
        return np.where(both | (lexical > 0), blended, -np.inf)


class Best:
    """The k best hits per query seen so far; ties go to the smaller id.  Nothing else is kept.

    With ``distinct`` rows that come twice count once.
    """

    def __init__(self, n_queries: int, k: int, min_score: float | None, distinct: bool = False):
        self.k, self.distinct, self.copies = k, distinct, 1
        self.floor = np.full(n_queries, -np.inf if min_score is None else min_score)
        self.query = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def passing(self, raw: np.ndarray, floor: np.ndarray, slack: float, share: float,
                least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places of a tile that may be among the k best; scores are known within ``slack`` and a ``share``."""
        if not raw.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = lambda f: (f - slack - share * np.abs(np.where(np.isfinite(f), f, 0.0)))[:, None].astype(raw.dtype)
        found = raw >= low(floor)
        if least > -np.inf:
            found &= raw > least
        width = raw.shape[1]
        deep = self.k * self.copies  # so many rows have k distinct ids at least
        if width > deep and np.count_nonzero(found) > 2 * deep * len(raw):
            # Whatever lies below the tile's own k-th score cannot be among the k best.
            found &= raw >= low(np.partition(raw, width - deep, axis=1)[:, width - deep].astype(np.float64))
        return np.divmod(np.flatnonzero(found), width)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        q, row = self.passing(scores, self.floor, 0.0, 0.0)
        some = scores[q, row] > -np.inf
        q, row = q[some], row[some]
        self.merge(q, ids[row], scores[q, row])

    def merge(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes hits in; only the queries that have new ones are sorted again."""
        some = scores >= self.floor[q]
        q, ids, scores = q[some], ids[some], scores[some]
        if not len(q):
            return
        touched = np.zeros(len(self.floor), bool)
        touched[q] = True
        old = touched[self.query]
        query, id_, score = np.r_[self.query[old], q], np.r_[self.id[old], ids], np.r_[self.score[old], scores]
        order = np.lexsort((id_, -score, query))
        query, id_, score = query[order], id_[order], score[order]
        if self.distinct:
            new = np.append(True, (np.diff(query) != 0) | (np.diff(id_) != 0) | (score[1:] != score[:-1]))
            query, id_, score = query[new], id_[new], score[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep, full = rank < self.k, rank == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
        self.query = np.r_[self.query[~old], query[keep]]
        self.id = np.r_[self.id[~old], id_[keep]]
        self.score = np.r_[self.score[~old], score[keep]]

    def batch(self, query_ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(self.query)), pa.array(self.id), pa.array(self.score)],
            ["query_id", "id", "score"])


def best_of(batches, queries: pa.Table, kernel, k: int, min_score, tile_cells: int, distinct: bool = False):
    """The k best hits of each query among the rows of all batches, as one batch for each block of queries.

    A tile is a block of queries by a slice of rows, both about the root of ``tile_cells`` if there
    are many queries.  Each block keeps its own hits, so what a tile costs does not depend on how
    many other queries there are.
    """
    queries = queries.combine_chunks()
    rows = max(64, math.isqrt(tile_cells), min(8192, tile_cells // max(1, queries.num_rows)))
    size = max(1, tile_cells // rows)
    shared, blocks = kernel.blocks(queries, size)
    found = [Best(min(size, queries.num_rows - i * size), k, min_score, distinct) for i in range(len(blocks))]
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            tile = batch.slice(at, rows)
            ids, encoded = tile.column("id").to_numpy(zero_copy_only=False), kernel.encoded(shared, tile)
            copies = int(np.unique(ids, return_counts=True)[1].max(initial=1)) if distinct else 1
            for block, best in zip(blocks, found):
                best.copies = copies
                kernel.into(block, encoded, ids, best)
    names = queries["query_id"].combine_chunks()
    for i, best in enumerate(found):
        yield best.batch(names.slice(i * size, size))


@dataclass(frozen=True)
class PairKernel:
    """Both scores of the blend apart: mapped cosine (0 without vectors), BM25, and is it a hit by vector."""

    terms: TermKernel
    weight: float
    digits: int = 4

    index_columns = ("embedding", "terms")
    query_columns = ("embedding", "terms", "weights")

    def block(self, queries: pa.Table):
        return _vectors(queries["embedding"].combine_chunks()), self.terms.block(queries)

    def pairs(self, block, batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (asked, has_asked), terms = block
        rows, has_row = _vectors(batch.column("embedding"))
        both = has_asked[:, None] & has_row[None, :]
        cos = np.zeros(both.shape)
        if both.any():
            cos = np.where(both, (1.0 + asked @ rows.T) / 2.0, 0.0)
        return cos, self.terms.raw(terms, batch), both


class Skyband:
    """The rows that can be among the k best of weight * cos + (1 - weight) * lex / best, whatever best is.

    A row goes if k others have at least its scores and win every tie.  Blends are rounded, so a
    row with a larger id must have no larger cosine, one with a smaller id one that is smaller by
    ``margin``.  Points that k rows dominate are kept per query and sort out most of a tile at once.
    """

    LEANINGS = (1.0, 0.8, 0.5, 0.0)

    def __init__(self, n_queries: int, k: int, margin: float):
        self.k, self.margin = k, margin
        self.points = np.full((n_queries, len(self.LEANINGS), 2), -np.inf)
        self.held = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0)] for _ in range(n_queries)]

    def _points(self, cos: np.ndarray, lex: np.ndarray) -> np.ndarray:
        """For each leaning the point that the k rows best by it dominate; for rows of a matrix."""
        cos = np.maximum(cos, 0.0)
        out = np.empty((len(cos), len(self.LEANINGS), 2))
        top = np.maximum(lex.max(axis=1, keepdims=True), 1e-300)
        for i, a in enumerate(self.LEANINGS):
            best = np.argpartition(-(a * cos + (1 - a) * lex / top), self.k - 1, axis=1)[:, :self.k]
            out[:, i, 0] = np.take_along_axis(cos, best, axis=1).min(axis=1)
            out[:, i, 1] = np.take_along_axis(lex, best, axis=1).min(axis=1)
        return out

    def _below(self, cos, lex, points) -> np.ndarray:
        cos = np.maximum(cos, 0.0)  # what a row without a vector adds to the blend
        out = np.zeros(cos.shape, bool)
        for i in range(points.shape[1]):
            out |= (cos <= points[:, i, 0, None] - self.margin) & (lex <= points[:, i, 1, None])
        return out

    def add(self, ids: np.ndarray, cos: np.ndarray, lex: np.ndarray, hit: np.ndarray) -> None:
        passing = hit & ~self._below(cos, lex, self.points)
        if cos.shape[1] > 4 * self.k and np.count_nonzero(passing) > 8 * self.k * len(cos):
            # Rows that are no hits have no scores, so they dominate none.
            passing &= ~self._below(cos, lex, self._points(np.where(hit, cos, -1.0), np.where(hit, lex, -1.0)))
        for q in np.flatnonzero(passing.any(axis=1)):
            at = np.flatnonzero(passing[q])
            new = (ids[at], cos[q, at], lex[q, at])
            self.held[q] = [np.concatenate(x) for x in zip(self.held[q], new)]
            if len(self.held[q][0]) > 16 * self.k:
                self._cut(q)

    def _cut(self, q: int) -> None:
        ids, cos, lex = self.held[q]
        keep = np.ones(len(ids), bool)
        x = np.maximum(cos, 0.0)
        for at in range(0, len(ids), 512):
            part = slice(at, at + 512)
            over = lex[None, :] >= lex[part, None]
            over &= (x[None, :] >= x[part, None] + self.margin) | ((x[None, :] >= x[part, None]) & (ids[None, :] < ids[part, None]))
            keep[part] = over.sum(axis=1) < self.k
        self.held[q] = [ids[keep], cos[keep], lex[keep]]
        if keep.sum() >= self.k:
            self.points[q] = self._points(cos[keep][None], lex[keep][None])[0]

    def batch(self, query_ids: pa.Array) -> pa.RecordBatch:
        for q in range(len(self.held)):
            self._cut(q)
        sizes = [len(h[0]) for h in self.held]
        columns = [np.concatenate([h[i] for h in self.held]) if self.held else np.zeros(0) for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(columns[0].astype(np.int64)),
             pa.array(columns[1]), pa.array(columns[2])], names=["query_id", "id", "cos", "lex"])


def skyband_of(batches, queries: pa.Table, kernel: PairKernel, k: int, tile_cells: int):
    """The rows of the batches that may be among the k best of each query's blend."""
    block = kernel.block(queries)
    band = Skyband(queries.num_rows, k, 10.0 ** -kernel.digits / kernel.weight)
    step = max(64, tile_cells // max(1, queries.num_rows))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            tile = batch.slice(at, step)
            cos, lex, both = kernel.pairs(block, tile)
            # -1 marks a row without a vector: it has no part in the cosine, but may hit by its words.
            band.add(tile.column("id").to_numpy(zero_copy_only=False), np.where(both, cos, -1.0), lex, both | (lex > 0))
    return band.batch(queries["query_id"].combine_chunks())
