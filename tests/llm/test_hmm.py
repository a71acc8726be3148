import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from quaero.llm import hmm, queries
from quaero.llm.hmm import HmmParams, States
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return States(norm(r.random(3), 0), norm(r.random(3), 0), norm(r.random((3, 3)), 1), norm(r.random((5, 3)), 0))


def every_path(seq, m, start):
    """(path, probability of path and symbols) for all state paths."""
    for path in itertools.product(range(3), repeat=len(seq)):
        p = start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, v in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[v, b]
        yield path, p


SEQUENCES = [np.array(s) for s in ([0, 1, 2, 4], [3], [2, 2, 0], [4, 0, 1, 1, 3, 2], [1, 0])]


def test_likelihood_sums_over_all_paths(model):
    got = hmm.log10_likelihoods(SEQUENCES, model)
    want = [math.log10(sum(p for _, p in every_path(s, model, model.start))) for s in SEQUENCES]
    assert np.allclose(got, want, atol=1e-12)


def test_expected_counts_are_those_of_all_paths(model):
    begins = np.array([True, False, True, True, False])
    starts, moves, emits, log = hmm.expected(SEQUENCES, begins, model)
    w_starts, w_moves, w_emits, w_log = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for s, begin in zip(SEQUENCES, begins):
        paths = list(every_path(s, model, model.start if begin else model.later))
        total = sum(p for _, p in paths)
        w_log += math.log(total)
        for path, p in paths:
            p /= total
            if begin:
                w_starts[path[0]] += p
            for a, b in zip(path, path[1:]):
                w_moves[a, b] += p
            for v, a in zip(s, path):
                w_emits[v, a] += p
    assert np.allclose(starts, w_starts) and np.allclose(moves, w_moves) and np.allclose(emits, w_emits) and np.isclose(log, w_log)


def test_long_sequences_stay_finite(model):
    long = np.random.default_rng(1).integers(0, 5, 50_000)
    assert np.isfinite(hmm.log10_likelihoods([long, long[:3]], model)).all()


def base(texts, train):
    seen = Counter()
    tokens = [(t or "").encode().lower().split() + [b""] for t in texts]
    for t, use in zip(tokens, train):
        if use:
            seen.update(t)
    n, v = sum(seen.values()), len(seen)
    return [(len(t), sum(seen[w] > 0 for w in t), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in t)) for t in tokens]


def check(rows, texts, train):
    want = Counter((k, u, n, round(b, 6)) for k, u, n, b in base(texts, train))
    assert Counter((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)


@pytest.mark.parametrize("p", [HmmParams(), HmmParams(states=3, frequent=40, classes=7, segment=16, chunk=500, rounds=1, start_texts=20)])
def test_base_scores_match_brute_force_and_states_help(spark, p):
    docs = queries.table(spark, SMALL, "documents").withColumn("train", ~queries.dealt("doc_id", 7, 2))
    rows = hmm.score_texts(docs, "train", p).collect()
    given = docs.select("doc_id", "text", "train").collect()
    assert all(r.train == (zlib.crc32(str(r.id).encode()) % 7 != 2) for r in rows)
    check(rows, [r.text for r in given], [r.train for r in given])
    held = [r for r in rows if not r.train]
    if p.frequent > 1000:
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_probabilities(spark, make):
    """Over all one-word texts of the vocabulary and an unseen word of each class, and the empty one: below 1."""
    words = [f"w{i}" for i in range(30)]
    docs = make([(i, " ".join(words[j % 30] for j in range(i, i + 1 + i % 4)), None, None, None) for i in range(200)], clash=False)
    asked = make([(1000 + i, w, None, None, None) for i, w in enumerate([*words, ""])], clash=False)
    both = docs.withColumn("train", F.lit(True)).unionByName(asked.withColumn("train", F.lit(False)))
    rows = hmm.score_texts(both, "train", HmmParams(states=2, frequent=10, classes=4)).filter("not train").collect()
    assert 0 < sum(10**r.score for r in rows) < 1


def test_more_rounds_fit_better(spark):
    docs = queries.table(spark, SMALL, "documents").withColumn("train", F.lit(True))
    fit = lambda n: hmm.score_texts(docs, "train", HmmParams(rounds=n, prior=1.0)).agg(F.sum("score")).first()[0]
    assert fit(4) > fit(1)


def test_odd_rows(make, odd_rows):
    docs = make(odd_rows).withColumn("train", F.coalesce(F.col("doc_id") != 7, F.lit(False)))
    rows = hmm.score_texts(docs, "train").collect()
    check(rows, [t for _, t, *_ in odd_rows], [i is not None and i != 7 for i, *_ in odd_rows])
    nothing = hmm.score_texts(make(odd_rows).withColumn("train", F.lit(False)), "train").collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in nothing} == {(0, 0, 0.0)}
    assert all(math.isfinite(r.score) for r in nothing)
    assert hmm.score_texts(make([]).withColumn("train", F.lit(True)), "train").count() == 0
