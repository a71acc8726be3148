import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quaero.llm import rangemax, words
from quaero.llm.rangemax import Items, Postings, RankParams

from samples import prose

ITEMS = "item_id long, text string, doc_id string, rank string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, best=10):
    """All documents scored for each item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in set(terms(text)) if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    r = random.Random(seed)
    docs = [(i, prose(seed + i, r.choice((0, 3, 20, 200)), 60)) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(25)]          # ties
    docs += [(5, "repeated row"), (5, "repeated row"), (None, prose(3, 30, 60)), (6, None), (7, ""), (8, " .,! "),
             (9, "Ünï漢字 x2 \x00 ABC-abc"), (10, prose(9, 30_000, 60))]
    items = [(i, prose(50 + i, 12, 60)) for i in range(15)] + [(90, "abc ünï漢字 nowhere"), (91, None), (92, ""), (93, "repeated"),
                                                               (93, "repeated"), (94, "x2")]
    return docs, items


@pytest.mark.parametrize("p", [RankParams(), RankParams(best=3, shard=40, wave=1, block_chars=500)])
def test_ranks_match_brute_force(make, spark, p):
    docs, items = corpus(1)
    frame = make([(i, t, None, None, None) for i, t in docs])
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], ITEMS)
    got = [(r.item, r.rank, r.doc, r.score) for r in rangemax.rank_documents(frame, asked, p).collect()]
    want = brute(docs, items, p.best)
    # Equal rows of a document have no order among them.
    assert sorted(got, key=str) == want


def test_terms_of_long_texts_are_cut_nowhere(monkeypatch):
    text = prose(2, 5000) + " ü" + "x" * 300
    whole = terms(text)
    monkeypatch.setattr(words, "PART", 100)
    monkeypatch.setattr(words.bundles, "__defaults__", (100,))
    got = [t for _, found in rangemax._terms([text]) for t in found.to_pylist()]
    assert got == whole


def test_range_maxima():
    r = random.Random(3)
    size = 50
    pairs = sorted({(r.randrange(6), r.randrange(size)) for _ in range(160)})
    term, place = (np.array(x) for x in zip(*pairs))
    impact = np.array([r.randint(1, 9) for _ in pairs])
    postings = Postings(term, place, impact, size)
    for _ in range(500):
        t, lo = r.randrange(7), r.randrange(size)
        hi = r.randint(lo, size)
        most, at = postings.largest(np.array([t]), np.array([lo]), np.array([hi]))
        inside = [(i, p) for (u, p), i in zip(pairs, impact) if u == t and lo <= p < hi]
        assert most[0] == max((i for i, _ in inside), default=0)
        assert not inside or (most[0], at[0]) in inside


def test_intervals_that_cannot_win_stay_closed():
    """With a clear winner most documents are never scored."""
    n = 4000
    term = np.concatenate((np.zeros(n, np.int64), np.ones(3, np.int64)))
    place = np.concatenate((np.arange(n), [5, 900, 3000]))
    impact = np.concatenate((np.arange(n) % 7 + 1, [1000, 1000, 1000]))
    postings = Postings(term, place, impact, n)
    seen = []
    score = postings.impacts
    postings.impacts = lambda t, d: (seen.append(len(d)), score(t, d))[1]
    item, doc, _ = rangemax.search(postings, Items([np.array([0, 1])]), np.zeros(1, np.int64), RankParams(best=3))
    assert {5, 900, 3000} == set(doc.tolist()) and sum(seen) < n / 4


def test_empty_tables(make, spark):
    docs, items = corpus(2, 10)
    frame = make([(i, t, None, None, None) for i, t in docs])
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], ITEMS)
    assert rangemax.rank_documents(make([]), asked).count() == 0
    assert rangemax.rank_documents(frame, asked.limit(0)).count() == 0
