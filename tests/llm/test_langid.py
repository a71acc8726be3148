import zlib

import numpy as np
import pytest

from quaero.llm import langid, queries

from samples import prose

SMALL = "/root/testdata/sf0.001"


def brute_counts(text, bins):
    from quaero.llm import codes

    plain = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(plain) + " "
    out = np.zeros(bins, int)

    def mix(x):
        return int(codes.mix(np.array([x % 2**64], np.uint64))[0])

    one = [mix(ord(c)) for c in line]
    two = [mix(a * 3 + b) for a, b in zip(one, one[1:])]
    three = [mix(a * 5 + b) for a, b in zip(two, one[2:])]
    for c, h in zip(line, one):
        if c != " ":
            out[h % bins] += 1
    for h in two + three:
        out[h % bins] += 1
    return out if plain else out * 0


def test_counts_match_a_plain_count():
    for text in ("Ein Satz, zwei: 3!", "éÈ ß", "...", "", "a", "漢字 x"):
        assert (langid.gram_counts(text, 512) == brute_counts(text, 512)).all()
    assert langid.gram_counts(None, 64).sum() == 0


def test_whole_long_texts_count():
    text = "ab " * 600_000
    assert langid.gram_counts(text, 64).sum() >= 600_000 * 7


def test_held_out_accuracy(spark):
    rows = queries.op1_language_id(spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in queries.table(spark, SMALL, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = queries.table(spark, SMALL, "documents").withColumn("held", queries.dealt("doc_id", 4, 2))
    wrong = docs.selectExpr("doc_id", "text", "if(held, 'zz', lang) as lang", "held")
    p = langid.LangParams(bins=1024, sample=50)
    a, b = (langid.fit(d.filter("NOT held"), p) for d in (docs, wrong))
    assert a.langs == b.langs and (a.centroids == b.centroids).all()


def test_far_texts_are_rejected(make):
    rows = [(i, prose(i, 80), "aa", None, None) for i in range(40)]
    model = langid.fit(make(rows), langid.LangParams(bins=2048, clusters=2))
    found = langid.predict(make([(1, prose(99, 80)), (2, "жщю" * 400), (3, "123"), (4, None)], "doc_id long, text string"),
                           model, ["doc_id", "score"]).collect()
    assert found[0].asDict().keys() == {"doc_id", "lang_pred", "score", "rejected"}
    assert {r.doc_id: (r.lang_pred, r.rejected) for r in found} == {
        1: ("aa", False), 2: ("aa", True), 3: ("und", True), 4: ("und", True)}


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_a_language_without_labels_is_rejected_and_others_stay(spark, left_out):
    """Learned from all rows that op1 learns from, short ones and those with a wrong label too."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs.filter(~queries.dealt("doc_id", 4, 2)).filter(f"lang <> '{left_out}'"))
    assert left_out not in model.langs
    rows = langid.predict(docs, model, ["lang", "text"]).collect()
    long = [r for r in rows if len(r.text or "") >= 500]
    assert np.mean([r.rejected for r in long if r.lang == left_out]) >= 0.8
    assert np.mean([r.rejected for r in long if r.lang != left_out]) <= 0.01
    assert np.mean([r.rejected for r in rows if r.lang != left_out and any(c.isalpha() for c in r.text or "")]) <= 0.02


def test_wrong_labels_open_no_language(make):
    """One label in a hundred is wrong: the language that they hold is still rejected."""
    import random

    def text(seed, letters):
        r = random.Random(seed)
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(150))

    own, other = "aeioubdk", "rstmnlpwz"
    rows = [(i, text(i, other if i % 100 == 0 else own), "aa", None, None) for i in range(600)]
    model = langid.fit(make(rows), langid.LangParams(bins=65536))
    found = langid.predict(make([(i, text(5000 + i, other if i < 20 else own), None, None, None) for i in range(40)]), model, ["doc_id"]).collect()
    assert sum(r.rejected for r in found if r.doc_id < 20) >= 18
    assert sum(r.rejected for r in found if r.doc_id >= 20) <= 1


def brute_model(rows, p):
    """Plain idf, vectors and cosines, one at a time, for the centroids of a model."""
    counts = [brute_counts(t or "", p.bins) for t in rows]
    df = sum((c > 0).astype(int) for c in counts)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    return counts, idf


def test_scores_match_plain_cosines(make):
    rows = [(i, prose(i if i % 2 else 300 + i, 60, 50) + (" żź" if i % 2 else " ßß"), "ab"[i % 2], None, None) for i in range(60)]
    p = langid.LangParams(bins=512, clusters=2)
    model = langid.fit(make(rows), p)
    counts, idf = brute_model([t for _, t, *_ in rows], p)
    assert np.allclose(idf, model.idf)
    got = {r.doc_id: r for r in langid.predict(make(rows), model, ["doc_id"]).collect()}
    for (i, *_), c in zip(rows, counts):
        v = c * idf
        cos = [float(v @ m / np.linalg.norm(v) / np.linalg.norm(m)) for m in model.centroids]
        best = int(np.argmax(cos))
        assert got[i].lang_pred == model.langs[best] and abs(got[i].score - cos[best]) < 1e-5


def test_one_key_on_many_rows_does_not_fill_the_sample(make):
    rows = [(1, prose(1, 30), "aa", None, None)] * 3000 + [(2, prose(i, 30), "aa", None, None) for i in range(50)]
    model = langid.fit(make(rows), langid.LangParams(bins=256, sample=100))
    assert set(model.langs) == {"aa"}


def test_odd_rows_and_empty_tables(make, odd_rows):
    docs = make(odd_rows)
    model = langid.fit(docs)
    found = langid.predict(docs, model, ["doc_id", "text"]).collect()
    assert len(found) == len(odd_rows)
    assert all(r.lang_pred == ("und" if not any(c.isalpha() for c in r.text or "") else "xx") for r in found)
    none = langid.fit(make([]))
    assert none.langs == []
    unknown = langid.predict(docs, none, ["doc_id", "text"]).collect()
    assert {r.lang_pred for r in unknown} == {"und"}
    assert all(r.rejected == (not any(c.isalpha() for c in r.text or "")) for r in unknown)
    assert langid.drop_unknown(docs, none).count() == sum(not r.rejected for r in unknown)
    assert langid.predict(make([]), model, ["doc_id"]).count() == 0
