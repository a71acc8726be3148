"""Embedding and vector search."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quaero.functions.arrays import exploded
from quaero.functions.text import column, terms
from quaero.operators.models import apply_model
from quaero.operators.scoring import VectorKernel
from quaero.operators.topk import grid_topk, topk_join
from quaero.params import Params


def hashed_vector(term_array: Column | str, dim: int) -> Column:
    """Term counts hashed into ``dim`` buckets (15 hex digits of the md5), scaled to length one.

    Each distinct term of a batch is hashed once.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def count(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        bucket = np.array([int(md5(t.encode()).hexdigest()[:15], 16) % dim for t in coded.dictionary.to_pylist()], np.int64)
        place = np.repeat(np.arange(len(sizes)), sizes) * dim + bucket[coded.indices.to_numpy()]
        out = np.bincount(place, minlength=len(sizes) * dim).reshape(len(sizes), dim).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        out = np.divide(out, norm[:, None], out=out, where=norm[:, None] > 0).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dim, pa.int32()), pa.array(out.ravel()),
                                        mask=pc.is_null(lists))

    return count(column(term_array))


def embed(df: DataFrame, text: str = "content", params: Params = Params(), model=None) -> DataFrame:
    """Add ``embedding array<float>``; ``model`` maps ``text`` to a column ``embedding``."""
    if model is not None:
        return apply_model(df, model, "embedding array<float>")
    return df.withColumn("embedding", hashed_vector(terms(text), params.embed_dim))


def vector_topk(index: DataFrame, queries: DataFrame, k: int, params: Params = Params(),
                threshold: float | None = None, normalised: bool = True,
                where: dict | None = None) -> DataFrame:
    """Exact k nearest rows per query: ``query_id, id, score, rank``.

    ``where`` is an equality filter on index columns, applied before scoring and pushed down
    to the scan.  Filtering by the score before or after the cut to k gives the same rows.
    """
    rows = matching(index, where).where(F.size("embedding") > 0)
    return topk_join(rows, queries.where(F.size("embedding") > 0),
                     VectorKernel(normalised), k, params, threshold)


def matching(index: DataFrame, where: dict | None) -> DataFrame:
    for name, value in (where or {}).items():
        index = index.where(F.col(name) == F.lit(value) if value is not None
                            else F.col(name).isNull())
    return index


def plane_sign(band: int, bit: int, axis: int) -> int:
    """Component of a random plane: the parity of the 32-bit fold of a fixed linear mix."""
    x = (band * 7919 + bit * 104729 + axis * 1299709 + 15485863) % 4294967291
    x = (x * 48271 + 11) % 2147483647
    x = (x * 69621 + 7) % 2147483647
    return 1 if (x // 65536) % 2 else -1


def signatures(df: DataFrame, dim: int, bands: int, bits: int, vector: str = "embedding") -> DataFrame:
    """One row per vector and band; ``bucket`` packs the band and the signs of its planes."""
    planes = np.array([[[plane_sign(b, i, a) for a in range(dim)] for i in range(bits)]
                       for b in range(bands)], dtype=np.float64)
    weights = 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def buckets(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, dim))
        # Round so that a projection of exactly zero has one sign whatever the summation order.
        signs = np.round(np.einsum("nd,bid->nbi", x, planes), 6) >= 0
        return pd.Series(list((signs @ weights) + (np.arange(bands) << bits)))

    return exploded(df, ["*"], buckets(vector), "bucket")


def vector_lsh_topk(index: DataFrame, queries: DataFrame, k: int, dim: int, bands: int = 16,
                    bits: int = 8, params: Params = Params(), threshold: float | None = None,
                    normalised: bool = True) -> DataFrame:
    """Approximate search: only rows that share a signature band with the query are scored.

    The scores of those rows are exact.  Hot buckets are cut into bounded pieces, none is capped.
    """
    return grid_topk(
        signatures(index.where(F.size("embedding") > 0), dim, bands, bits),
        signatures(queries.where(F.size("embedding") > 0), dim, bands, bits),
        VectorKernel(normalised), k, params, threshold, bucketed=True)
