"""Leakage over long texts and many answers: the passages that hold most trigrams, found without a square of the input."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaero.operators.scoring import ShareKernel, best_of
from quaero.operators.topk import rounds_topk
from quaero.params import Params
from quaero.plans.evaluate import as_questions, evaluate, leakage, save_results, trigrams, with_leakage


def grams(text):
    text = "".join(text.split())
    return {text[i:i + 3] for i in range(max(1, len(text) - 2))}


def texts(n, longest, seed):
    rng = np.random.default_rng(seed)
    parts = np.array(["an", "be ", "the", "or", "𝒳y", "日本", "a\n", "é", "zu ", "q"])
    return ["".join(rng.choice(parts, rng.integers(0, longest))) for _ in range(n)]


def nearest(asked, passages):
    held = [grams(t) for t in passages]
    found = {}
    for i, text in enumerate(asked):
        own = grams(text)
        share, at = max(((len(own & h), -j) for j, h in enumerate(held)), default=(0, 0))
        if share:
            found[str(i)] = (-at, pytest.approx(share / len(own), abs=1e-4))
    return found


@pytest.mark.parametrize("params", [Params(), Params(seed_rows=3, tile_cells=600, broadcast_bytes=20_000, cell_queries=7)])
def test_leakage_is_exact_in_parts(spark, params):
    passages, asked = texts(150, 300, 1) + ["", "ab"], texts(60, 60, 2) + ["", "ab", "none like it 12"]
    pairs = spark.createDataFrame([(str(i), "q", t) for i, t in enumerate(asked)],
                                  "request_id string, request string, expected_response string")
    corpus = spark.createDataFrame(list(enumerate(passages)), "id long, content string")
    got = {r.request_id: (r.id, r.containment) for r in leakage(pairs, corpus, params).collect()}
    assert got == nearest(asked, passages)


def test_trigrams_of_a_long_text_take_no_square_of_its_length(spark):
    """Each trigram was cut by counting from the start of the text."""
    long = "".join(texts(1, 2, 3)) + " ".join(str(i) for i in range(150_000))
    frame = spark.createDataFrame([(long,)], "t string")
    at = time.perf_counter()
    n = frame.select(F.size(trigrams(F.col("t"))).alias("n")).first().n
    assert n == len(grams(long)) and time.perf_counter() - at < 10


def test_a_pair_that_lacks_too_much_is_left_early():
    rng = np.random.default_rng(5)
    asked = [sorted(rng.choice(5000, rng.integers(1, 400), replace=False).tolist()) for _ in range(90)]
    lists = [rng.choice(5000, rng.integers(0, 4000), replace=False).tolist() for _ in range(300)]
    share = np.array([[round(len(set(q) & set(r)) / len(q), 4) for r in lists] for q in asked])
    floor = share.max(axis=1)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(300), pa.int64()), "terms": pa.array(lists, pa.list_(pa.int64()))})
    for floors in (np.full(90, -np.inf), floor):
        queries = pa.table({"query_id": range(90), "terms": pa.array(asked, pa.list_(pa.int64())), "floor": floors})
        hits = pa.Table.from_batches(best_of([batch], queries, ShareKernel(), 1, None, 4000, True)).to_pylist()
        got = {h["query_id"]: (h["id"], h["score"]) for h in hits}
        assert set(got) == {i for i in range(90) if floor[i] > 0}
        for i, (row, score) in got.items():
            assert abs(score - floor[i]) <= 1.01e-4 and abs(share[i, row] - floor[i]) <= 1.01e-4


def test_rounds_shuffle_no_rows(spark, folder):
    rows = spark.range(500).select("id", F.array(F.col("id") % 7, F.col("id") % 11 + 100).alias("terms"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.col("id") % 7, F.col("id") % 11 + 100).alias("terms"),
                                    F.lit(float("-inf")).alias("floor"))
    rows.write.parquet(f"{folder}/rows")
    asked.write.parquet(f"{folder}/asked")
    hits = rounds_topk(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/asked"), ShareKernel(), 2,
                       Params(broadcast_queries=50))
    got = {(r.query_id, r.rank): (r.id, r.score) for r in hits.collect()}
    alike = {q: [i for i in range(500) if i % 77 == q % 77][:2] for q in range(300)}
    assert got == {(q, n + 1): (alike[q][n], 1.0) for q in range(300) for n in range(2)}
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = plan.split("MapInArrow")[1:]
    assert len(scans) >= 6 and all("Exchange" not in s[:s.index("FileScan")] for s in scans)


def test_verdicts_with_leakage_of_a_long_passage(spark, folder):
    """What `evaluation_sink` saves; a long passage alone took its time."""
    long = " ".join(str(i) for i in range(60_000))
    pairs = spark.createDataFrame([("1", "q", "59998 59999"), ("2", "q", "ü")], "request_id string, request string, expected_response string")
    corpus = spark.createDataFrame([(4, long), (5, "59998")], "id long, content string")
    answers = as_questions(pairs).select("query_id", F.lit("c").alias("context"), F.lit("a").alias("answer"))
    at = time.perf_counter()
    saved = save_results(with_leakage(evaluate(pairs, answers), leakage(pairs, corpus)), folder, "run")
    assert {r.request_id: (r.leaked_from, r.containment) for r in saved.collect()} == {"1": (4, 1.0), "2": (None, None)}
    assert time.perf_counter() - at < 25
