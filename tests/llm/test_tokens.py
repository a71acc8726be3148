"""Token counts and packing, against the tokenizer library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from quaero.llm import bpe, packing, queries
from samples import prose
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    signs = ["a", "b", " ", "  ", "\n", "\t", "A", "é", "'s", "'ll", "<|endoftext|>", "<|endof", "漢", "\U0001f600", "0", "99", ".", "...", "the ", " of", " ", "　", "‍"]
    out = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return out + ["a" * 3000, "ab" * 2000, " " * 5000, "\n" * 999 + "x", "aaa" * 7, "<|endoftext|>", "don't", "", prose(5, 60_000), " " * 300_000]


@pytest.mark.parametrize("chars", [1 << 20, 64])
def test_counts_are_the_librarys(library, texts, chars):
    some = texts if chars > 64 else texts[:800]
    counter = bpe.TokenCounter(bpe.CountParams(batch_chars=chars, cache=500))
    assert counter.count([*some, None]) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)] + [0]


def test_ids_are_the_librarys(library, texts):
    encoder = packing.Encoder(packing.PackParams())
    for t in texts:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert encoder.ids(None) == b""


def test_registered_count(spark, library):
    docs = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").collect()}
    rows = queries.op9_token_counts(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_odd_rows_are_counted(make, odd_rows, library):
    rows = bpe.token_counts(make(odd_rows)).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert Counter((r.id, r.n_tokens) for r in rows) == Counter((i, size(t)) for i, t, *_ in odd_rows)
    assert bpe.token_counts(make([])).count() == 0


def check_packed(rows, docs, library, window=2048):
    """docs: (id, text) rows; every id lies in one piece, sequences are gapless and within the window."""
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    got = Counter((r["doc"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    want = Counter()
    for key, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), window):
            part = ids[s:s + window]
            want[key, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert got == want
    tokens = sum(r["length"] for r in rows)
    return len(places), tokens


def test_registered_packing(spark, library):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]
    rows = [r.asDict() for r in queries.op10_packing(spark, SMALL).withColumnRenamed("doc_id", "doc").collect()]
    sequences, tokens = check_packed(rows, docs, library)
    assert sequences * 2048 <= tokens * 1.01


def test_odd_rows_are_packed(make, odd_rows, library):
    found = packing.pack(make(odd_rows), ids=True)
    rows = [r.asDict() for r in found.collect()]
    check_packed(rows, [(i, t) for i, t, *_ in odd_rows], library)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack(make([])).count() == 0


def test_fullest_is_the_best_subset():
    r = random.Random(6)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        used = packing.fullest(counts, 40)
        assert all(0 < n <= counts[length] for length, n in used.items())
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= 40}
        assert sum(length * n for length, n in used.items()) == max(sums)


def test_plan_uses_everything_once():
    counts = {7: 10**9, 2048: 5, 1000: 3, 1: 17, 1500: 10**6}
    total = Counter()
    for used, times in packing.plan(counts, 2048):
        assert sum(k * n for k, n in used.items()) <= 2048
        for length, n in used.items():
            total[length] += n * times
    assert total == counts
