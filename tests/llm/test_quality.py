import zlib

import numpy as np
from quaero.llm import quality, queries
from quaero.llm.quality import STATS, QualityModel, QualityParams
from samples import prose

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op3_quality(spark, SMALL).collect()
    labels = {r.doc_id: r.quality for r in queries.table(spark, SMALL, "labels").collect()}
    assert len(rows) == queries.table(spark, SMALL, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_statistics_by_hand():
    got = dict(zip(STATS, quality.statistics("Ab cd, EF|g\nAb 12!")))
    assert got["chars"] == 18 and got["words"] == 5 and got["lines"] == 2
    assert got["letters"] == 9 / 18 and got["upper"] == 4 / 9 and got["digits"] == 2 / 18 and got["blanks"] == 4 / 18
    assert got["commas"] == 1 / 5 and got["bars"] == 1 / 5 and got["shouts"] == 1 / 5
    assert got["longest_word"] == 4 and got["word_length"] == 14 / 5 and got["short_words"] == 4 / 5
    assert got["distinct_words"] == 4 / 5 and got["top_word"] == 2 / 5 and got["upper_words"] == 1 / 5 and got["marked_words"] == 2 / 5
    assert quality.statistics(None) == quality.statistics("")


def test_compiled_rules_are_the_model(spark):
    r = np.random.default_rng(1)
    x = r.random((400, len(STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.6)).astype(float)
    model = quality.fit_rules(x, y, QualityParams(trees=15))
    assert 0 < len(model.rules) < 60
    total = model.base + sum(w * quality.holds(rule, x) for rule, w in zip(model.rules, model.weights))
    want = 1 / (1 + np.exp(-total))
    assert np.mean((want >= 0.5) == (y > 0)) > 0.95
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *STATS])
    got = {row.i: row.s for row in frame.select("i", quality.compiled(model).alias("s")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-12)


def test_odd_rows_and_labels(spark, make, odd_rows):
    stats = quality.with_statistics(make(odd_rows), ["doc_id", "words", "held_out"])
    assert stats.columns == ["doc_id", "held_out", *STATS] and stats.count() == len(odd_rows)
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (3, None, "x"), (None, 0, "x"), (4, 7, "x")], "doc_id long, quality int, score string")
    for known in (labels, labels.limit(0)):
        model = quality.fit(stats, known)
        assert model.rules == []
        assert {0 <= r.s <= 1 for r in stats.select(quality.compiled(model).alias("s")).collect()} == {True}
    assert quality.fit(stats.limit(0), labels) == QualityModel(0.0)
    assert quality.with_statistics(make([]), ["doc_id"]).count() == 0


def test_long_texts_count_whole():
    text = prose(4, 200_000)
    assert dict(zip(STATS, quality.statistics(text)))["words"] == 200_000
