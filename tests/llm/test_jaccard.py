import random
from collections import Counter

import pytest

from quaero.llm import jaccard
from quaero.llm.joins import components
from quaero.llm.jaccard import JaccardParams

from samples import prose


def grams(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, threshold=0.8):
    """(links, smallest index of the component) of each text."""
    sets = [grams(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(links[i], find(i)) for i in range(len(sets))]


def corpus(groups=8, near=12, lone=20):
    """Groups of edited copies, some edited beyond the threshold, a passage shared by all, and copies."""
    r = random.Random(5)
    shared = prose(77, 40)
    texts = []
    for g in range(groups):
        base = prose(g, 100).split()
        for _ in range(near):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w))
        texts += [texts[-1]] * 3
    texts += [prose(100 + i, 60) + " " + shared for i in range(lone)] + ["a b", "a b", "a", "A  B\n", "x y z u v", "x y z u v w"]
    return texts


@pytest.mark.parametrize("p", [JaccardParams(), JaccardParams(small=4, block=8, block_words=500), JaccardParams(small=4, part=5, block=8, block_rows=3)])
def test_links_match_brute_force(make, p):
    texts = corpus()
    docs = make([(i, t, None, None, None) for i, t in enumerate(texts)])
    found = {r.id: r for r in jaccard.jaccard_classes(docs, p).collect()}
    want = brute(texts)
    assert [(found[i].n_links, found[i].class_id) for i in range(len(texts))] == want
    assert {i for i, r in found.items() if r.kept} == {i for i, (_, c) in enumerate(want) if i == c}


def test_shingles_are_those_of_words():
    for text in ("A b  C\td\ne f", "one", "", None, "x " * 50, "ß İ   z y w"):
        assert len(jaccard.shingles(text, 5)) == len(grams(text))
    long = prose(1, 300_000, 5000)
    assert len(jaccard.shingles(long, 5)) == len(grams(long))
    assert (jaccard.shingles("a B c d e f", 5) == jaccard.shingles("A b\nC  d e F", 5)).all()


def test_odd_rows(make, odd_rows):
    found = jaccard.jaccard_classes(make(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by = Counter((r.id, r.n_links, r.class_id, r.kept) for r in found)
    want = Counter([(1, 2, 1, True), (1, 2, 1, False), (2, 2, 1, False), (1, 1, 1, True), (None, 1, 1, False), (3, 0, 3, True),
                    (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (9, 1, 7, False),
                    (8, 0, 8, True), (10, 0, 10, True)])
    assert by == want
    left = jaccard.drop_near_duplicates(make(odd_rows))
    assert left.columns == make([]).columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(r[0] for r in want.elements() if r[3])


def test_empty_table(make):
    assert jaccard.jaccard_classes(make([])).count() == 0
    assert jaccard.drop_near_duplicates(make([])).count() == 0


def near_copies(n):
    """Copies of one text with up to two words changed."""
    r = random.Random(3)
    base = prose(4, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_edges_of_a_hot_group(make, spark, monkeypatch):
    """A group that meets in every node costs at most a row a node and set, however many blocks it fills."""
    texts = near_copies(700) + [prose(100 + i, 60) for i in range(50)]
    seen = {}
    write = jaccard.staged

    def counting(df, name, folder=None):
        out = write(df, name, folder)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", counting)
    p = JaccardParams(part=64, block=128, block_rows=128)
    found = {r.id: r for r in jaccard.jaccard_classes(make([(i, t, None, None, None) for i, t in enumerate(texts)]), p).collect()}
    assert [(found[i].n_links, found[i].class_id) for i in range(len(texts))] == brute(texts)
    assert 0 < seen["edges"] <= seen["large"] + 750
    assert seen["mixed"] <= 5


def test_near_copies_are_not_split(make, monkeypatch):
    """Sets of a large node that lie in one group by then do not go on; each went down to the deepest level, about 50 rows."""
    texts = near_copies(700) + [prose(100 + i, 60) for i in range(50)]
    seen = []
    write = jaccard.staged

    def counting(df, name, folder=None):
        out = write(df, name, folder)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "staged", counting)
    found = {r.id: r for r in jaccard.jaccard_classes(make([(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert [(found[i].n_links, found[i].class_id) for i in range(len(texts))] == brute(texts)
    split = [n for name, n in seen if name in ("sets", "level-2", "level-3")]
    assert sum(split) <= 750


def test_sets_beside_a_group_do_not_split_it(make, monkeypatch):
    """A few sets that share much with a large group, but are not near, sent the group down every level."""
    r = random.Random(8)
    texts = near_copies(500)
    for i in range(60):
        w = texts[0].split()
        for j in r.sample(range(len(w)), 9):
            w[j] = f"far{i}x{j}"
        texts.append(" ".join(w))
    seen = []
    write = jaccard.staged

    def counting(df, name, folder=None):
        out = write(df, name, folder)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "staged", counting)
    p = JaccardParams(block=128)
    found = {r.id: r for r in jaccard.jaccard_classes(make([(i, t, None, None, None) for i, t in enumerate(texts)]), p).collect()}
    assert [(found[i].n_links, found[i].class_id) for i in range(len(texts))] == brute(texts)
    assert dict(seen)["mixed"] > 0
    assert sum(n for name, n in seen if name == "sets") <= len(texts)


def test_many_repeated_rows(make, spark):
    a, b = near_copies(2)
    rows = [(1, a, None, None, None)] * 3000 + [(2, b, None, None, None)]
    found = jaccard.jaccard_classes(make(rows))
    got = Counter((r.id, r.n_links, r.class_id, r.kept) for r in found.collect())
    assert got == Counter({(1, 3000, 1, False): 2999, (1, 3000, 1, True): 1, (2, 3000, 1, False): 1})


def test_ties_leave_no_link_out():
    r = random.Random(2)
    import numpy as np

    x = np.array([[r.randint(1, 3) for _ in range(12)] for _ in range(60)], np.uint8)
    like = {(i, j) for i in range(60) for j in range(60) if i != j and (x[i] == x[j]).sum() >= 0.6 * 12}
    root = list(range(60))
    for _ in range(60):
        for i, j in like:
            root[i] = root[j] = min(root[i], root[j])
    labels = np.arange(60)
    node, low = jaccard.fold(*jaccard.tie(x, labels, 0.6))
    got = dict(zip(node.tolist(), low.tolist()))
    assert [got.get(i, i) for i in range(60)] == root
    parts = [jaccard.tie(x[:30], labels[:30], 0.6), jaccard.tie(x[30:], labels[30:], 0.6),
             jaccard.tie_across(x[:30], labels[:30], x[30:], labels[30:], 0.6)]
    node, low = jaccard.fold(*map(np.concatenate, zip(*parts)))
    got = dict(zip(node.tolist(), low.tolist()))
    assert [got.get(i, i) for i in range(60)] == root
    assert len(jaccard.tie(np.ones((500, 12), np.uint8), np.arange(500), 0.6)[0]) == 499


def test_components_of_chains_and_hubs(spark, folder):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    hub = [(5000, 5000 + i) for i in range(1, 400)]
    loose = [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + hub + loose
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b", folder, "c").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
