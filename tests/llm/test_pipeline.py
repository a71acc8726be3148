import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from quaero.llm import decontaminate, packing, secrets
from quaero.sources.workdir import staged
from samples import prose
from test_jaccard import brute as classes
from test_secrets import brute as base_spans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), name, folder)
        out.append(docs)
    return out


def test_stages_keep_the_columns(outputs):
    assert [len(x) for x in (corpus_pipeline.STAGES, outputs)] == [5, 6]
    for docs in outputs[1:5]:
        assert docs.dtypes == outputs[0].dtypes


def test_language_keeps_clean_documents(outputs):
    before, after = outputs[0].collect(), outputs[1].collect()
    lost = {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")} - {r.doc_id for r in after}
    assert len(lost) <= 0.005 * len(before)
    assert all(any(c.isalpha() for c in r.text) for r in after)


def test_one_document_of_each_class_stays(outputs):
    docs = sorted(outputs[1].collect(), key=lambda r: r.doc_id)
    want = {docs[i].doc_id for i, (_, c) in enumerate(classes([r.text for r in docs])) if i == c}
    assert {r.doc_id for r in outputs[2].collect()} == want
    assert outputs[2].count() == len(want)


def test_contaminated_documents_go(outputs, spark):
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = outputs[2].collect(), {r.doc_id for r in outputs[3].collect()}
    exact = {r.doc_id for r in before if any(i in decontaminate.plain(r.text) for i in items)}
    assert exact and not exact & after
    assert after == {r.doc_id for r in before} - exact  # the given copies are unchanged


def test_secrets_are_masked(outputs):
    before = {r.doc_id: r for r in outputs[3].collect()}
    after = {r.doc_id: r for r in outputs[4].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        assert (r.text == before[i].text) == (not base_spans(before[i].text))
        assert secrets.KINDS and not base_spans(re.sub(r"\[SECRET\]", " ", r.text))


def test_sequences_hold_every_token(outputs):
    rows = outputs[5].collect()
    encoder = packing.Encoder(packing.PackParams())
    tokens = {r.doc_id: len(encoder.ids(r.text)) // 4 + 1 for r in outputs[4].collect()}
    held = Counter()
    for r in rows:
        held[r.doc_id] += r.length
    assert held == tokens


def test_run_is_the_stages(spark, outputs):
    rows = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows.collect()) == Counter(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in outputs[5].collect())


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, make, odd_rows, folder, empty):
    rows = [] if empty else [*odd_rows, (20, prose(1, 120) + " token=abcdefgh " + prose(2, 30), "xx", "s", 5)]
    docs = make(rows)  # with columns whose names clash
    names = docs.columns
    sizes = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, SMALL), name, folder)
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == names
            assert {r[0] for r in docs.select("score").collect()} <= {"x"}
    assert sizes == ([0] * 5 if empty else [10, 6, 6, 6, sizes[-1]]) and np.isfinite(sizes[-1])
