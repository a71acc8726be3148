"""Search against brute force, also under skew and beyond the broadcast bound."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.operators import vector as V
from quaero.operators.keyword import corpus_stats, hybrid_topk, keyword_topk, rrf_topk, with_terms
from quaero.params import Params
from quaero.plans.index import build_index
from quaero.plans.retrieve import retrieve

GRID = Params(broadcast_queries=0, cell_rows=7, cell_queries=3)
TILES = Params(tile_cells=1)


def vectors(spark, matrix, id_):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)],
                                 f"{id_} long, embedding array<float>")


def rows_of(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


def brute(scores, k, low=-math.inf):
    out = []
    for q, row in enumerate(scores):
        order = sorted((-s, i) for i, s in enumerate(row) if s >= low)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    index = rng.normal(size=(300, 8)).astype(np.float32)
    index[100:200] = index[0]          # a third of all rows are copies of one vector
    queries = np.vstack([rng.normal(size=(10, 8)), index[0:1]]).astype(np.float32)
    a = index.astype(float) / np.linalg.norm(index.astype(float), axis=1, keepdims=True)
    b = queries.astype(float) / np.linalg.norm(queries.astype(float), axis=1, keepdims=True)
    return index, queries, b @ a.T


@pytest.mark.parametrize("params", [Params(), GRID, TILES])
def test_vector_search_is_exact_with_ties_by_id(spark, cloud, params):
    index, queries, cos = cloud
    got = V.vector_topk(vectors(spark, index, "id").repartition(5), vectors(spark, queries, "query_id"), 20,
                        params)
    assert rows_of(got) == brute(np.round((1 + cos) / 2, 6), 20)


@pytest.mark.parametrize("params", [Params(), GRID])
def test_threshold_and_filter(spark, cloud, params):
    index, queries, cos = cloud
    table = vectors(spark, index, "id").withColumn("kind", F.col("id") % 3)
    got = V.vector_topk(table, vectors(spark, queries, "query_id"), 5, params, threshold=0.8, where={"kind": 1})
    score = np.round((1 + cos) / 2, 6)
    score[:, np.arange(300) % 3 != 1] = -1
    assert rows_of(got) == brute(score, 5, 0.8)


def test_lsh_scores_are_exact_and_hot_buckets_lose_nothing(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    data = np.vstack([centers[i % 12] + 0.05 * rng.normal(size=16) for i in range(240)]
                     + [centers[0]] * 120).astype(np.float32)
    queries = data[::30]
    index, asked = vectors(spark, data, "id"), vectors(spark, queries, "query_id")
    exact = rows_of(V.vector_topk(index, asked, 10))
    small = Params(cell_rows=20, cell_queries=2)
    near = rows_of(V.vector_lsh_topk(index, asked, 10, 16, bands=12, bits=6, params=small))
    big = rows_of(V.vector_lsh_topk(index, asked, 10, 16, bands=12, bits=6))
    assert near == big
    same = {(q, i, s) for q, _, i, s in exact} & {(q, i, s) for q, _, i, s in near}
    assert len(same) >= 0.95 * len(exact)


WORDS = "the of red blue cat dog bird sky sea sun moon star rain wind fire rock tree leaf fish stone".split()


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    p = np.array([8.0 if w in ("the", "of") else 1.0 for w in WORDS])
    docs = [" ".join(rng.choice(WORDS, size=rng.integers(0, 30), p=p / p.sum())) for _ in range(120)]
    docs[40:80] = [docs[3]] * 40
    asked = ["the red cat", "OF the the sea, fish!", "unknown words", "", "moon"]
    return docs, asked


def bm25(docs, asked, k1=1.2, b=0.75):
    toks = [re.findall(r"\w+", d.lower()) for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    df = Counter(t for d in toks for t in set(d))
    out = np.zeros((len(asked), len(docs)))
    for q, text in enumerate(asked):
        for t in set(re.findall(r"\w+", text.lower())):
            idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) if df[t] else 0
            for i, d in enumerate(toks):
                tf = d.count(t)
                out[q, i] += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg)) if tf else 0
    return out


def tables(spark, texts):
    docs, asked = texts
    index = spark.createDataFrame([(i, "u", d) for i, d in enumerate(docs)], "id long, url string, content string")
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, text string")
    return index, queries


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(abs(x[3] - y[3]) < 2e-4 for x, y in zip(a, b))


@pytest.mark.parametrize("params", [Params(), GRID, TILES])
def test_keyword_search_is_exact(spark, texts, params):
    index, queries = tables(spark, texts)
    rows = with_terms(index)
    got = keyword_topk(rows, queries, corpus_stats(rows), 20, params)
    close(rows_of(got), brute(np.where(np.round(bm25(*texts), 4) > 0, np.round(bm25(*texts), 4), -1), 20, 0))


def test_terms_of_many_queries_score_the_same(spark, texts):
    index, _ = tables(spark, texts)
    rows = with_terms(index)
    asked = [f"the of {w}" for w in WORDS] * 3
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, text string")
    score = np.round(bm25(texts[0], asked), 4)
    close(rows_of(keyword_topk(rows, queries, corpus_stats(rows), 7)),
          brute(np.where(score > 0, score, -1), 7, 0))


def test_hybrid_blend_and_threshold(spark, texts):
    index = build_index(tables(spark, texts)[0])
    queries = tables(spark, texts)[1]
    vec = {(r.query_id, r.id): r.score for r in retrieve(queries, index, 200, mode="vector").collect()}
    lex = bm25(*texts)
    best = np.round(lex.max(axis=1), 4)
    score = np.full(lex.shape, -1.0)
    for (q, i), s in vec.items():
        score[q, i] = round(0.5 * s + 0.5 * (lex[q, i] / best[q] if best[q] else 0), 4)
    keep = [q for q in range(len(texts[1])) if texts[1][q]]
    got = [r for r in rows_of(retrieve(queries, index, 10, 0.6, "hybrid")) if r[0] in keep]
    want = [r for r in brute(score, 10, 0.6) if r[0] in keep]
    assert len(got) == len(want) and all(r[3] >= 0.6 for r in got)
    assert all(abs(a[3] - b[3]) < 3e-4 for a, b in zip(got, want))


def test_rank_fusion(spark):
    schema = "query_id long, id long, rank int"
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], schema)
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], schema)
    rows = rows_of(rrf_topk(a, b, 2))
    assert [(r[2], r[3]) for r in rows] == [(11, round((1 / 62 + 1 / 61) * 30.5, 6)), (10, 0.5)]


def test_unknown_mode_and_useless_threshold_are_refused(spark, texts):
    index = build_index(tables(spark, texts)[0])
    queries = tables(spark, texts)[1]
    for bad in (dict(mode="fuzzy"), dict(mode="keyword", threshold=0.7),
                dict(mode="hybrid", fusion="rrf", threshold=0.7), dict(mode="hybrid", fusion="x")):
        with pytest.raises(ValueError):
            retrieve(queries, index, 5, **bad)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_shuffle_hits_only(spark, texts):
    index, queries = tables(spark, texts)
    rows = with_terms(index)
    plan = plan_of(keyword_topk(rows, queries, corpus_stats(rows), 5))
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    assert plan.count("Exchange") == 2  # hits by salt, then by query
    assert "Partial" in plan[plan.index("Exchange"):] and "MapInArrow" in plan


def test_filter_reaches_the_scan(spark, cloud, folder):
    index, queries, _ = cloud
    vectors(spark, index, "id").withColumn("kind", F.col("id") % 3).write.parquet(folder + "/v")
    df = V.vector_topk(spark.read.parquet(folder + "/v"), vectors(spark, queries, "query_id"), 5,
                       where={"kind": 1})
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,1)]" in plan_of(df)


def test_hashed_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "t array<string>")
    got = [r[0] for r in df.select(V.hashed_vector("t", 16)).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6 and len(got[0]) == 16
    assert got[1] == [0.0] * 16 and got[2] is None
