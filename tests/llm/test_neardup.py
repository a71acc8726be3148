import random
from collections import Counter

import numpy as np
import pytest
from quaero.llm import neardup, queries
from quaero.llm.neardup import NearParams

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(vectors, threshold=0.9):
    n = len(vectors)
    x = [neardup.scaled(list(v)) if v is not None else None for v in vectors]
    links = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j])
              and x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((len(links[i]), min(seen)))
    return out


def clusters(seed, n, dim=12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dim))
    return [list(map(float, np.float32(centres[i % 6] * r.uniform(0.5, 4) + r.standard_normal(dim) * r.choice([0.1, 0.25, 0.5, 1.5])))) for i in range(n)]


@pytest.mark.parametrize("p", [NearParams(), NearParams(cell=40, fan=7, tile=16), NearParams(cell=10, fan=3, depth=2), NearParams(threshold=0.5, cell=64, levels=2)])
def test_links_match_brute_force(make, p):
    vectors = clusters(1, 500) + clusters(2, 30, dim=3)
    vectors += vectors[:20] + vectors[:5] * 3 + [[1.0, 0.0], [9.0, 19 ** 0.5], [0.0, 1.0]]
    docs = make([(i, v, 0) for i, v in enumerate(vectors)], VECTORS.replace("float", "double"))
    found = {r.id: (r.n_links, r.class_id) for r in neardup.cosine_classes(docs, p).collect()}
    assert [found[i] for i in range(len(vectors))] == brute(vectors, p.threshold)


def test_tight_clusters_meet_few_others(make, monkeypatch):
    """Rows before the comparison grow about in proportion to the vectors."""
    r = np.random.default_rng(7)
    centres = r.standard_normal((400, 32))
    met = []
    write = neardup.staged

    def counting(df, name, folder=None):
        out = write(df, name, folder)
        if name == "others":
            met.append(sum(len(x.others) * x.n for x in out.collect()))
        return out

    monkeypatch.setattr(neardup, "staged", counting)
    for n in (600, 2400):
        rows = [(i, list(map(float, centres[i % (n // 100)] + 0.02 * r.standard_normal(32))), 0) for i in range(n)]
        found = neardup.cosine_classes(make(rows, VECTORS), NearParams(cell=60, fan=64)).collect()
        assert len({x.class_id for x in found}) == n // 100
    assert met[1] <= 8 * met[0] and met[1] <= 20 * 2400, met


def test_a_repeated_vector_does_not_take_all_centres(make):
    """Whichever vector sorts first, its copies leave room for others."""
    vectors = clusters(5, 60)
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(1000 + i, vectors[j], 0) for j in range(3) for i in range(200 * j, 200 * j + 200)]
    found = {r.id: (r.n_links, r.class_id) for r in neardup.cosine_classes(make(rows, VECTORS), NearParams(cell=20, fan=8)).collect()}
    assert [found[i] for i, _, _ in rows] == [(n, rows[c][0]) for n, c in brute([v for _, v, _ in rows])]


def test_odd_vectors(make):
    nan, inf = float("nan"), float("inf")
    a = [1.0, 2.0]
    rows = [(1, a), (2, a), (1, a), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (None, a), (9, [2.0, 4.0]), (10, [-1.0, -2.0]), (11, [1e-38, 2e-38]), (None, [0.0, 0.0]), (12, [1.0, 2.0, 0.0])]
    docs = make([(i, v, None) for i, v in rows], VECTORS)
    got = Counter((r.id, r.n_links, r.class_id) for r in neardup.cosine_classes(docs).collect())
    linked = [1, 2, 1, None, 9, 11]
    alone = [3, 4, 5, 6, 7, 8, 10, None, 12]
    assert got == Counter([(i, 5, 1) for i in linked] + [(i, 0, i) for i in alone])
    big = make([(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1e200, -1e200], 0)], "vec_id long, embedding array<double>, label int")
    assert {(r.id, r.n_links) for r in neardup.cosine_classes(big).collect()} == {(1, 1), (2, 1), (3, 0)}
    assert neardup.cosine_classes(make([], VECTORS)).count() == 0


def test_nets_cover_and_nest():
    x = neardup.units(np.array(clusters(3, 300)))
    p = NearParams(levels=5)
    above = np.zeros(len(x), int)
    for level, own in enumerate(neardup.nets(x, p)):
        radius = p.reach / 2**level
        gap = np.linalg.norm(x - x[own], axis=1)
        assert (gap <= radius + 1e-6).all()                       # covering
        assert (above[own] == above).all()                        # nesting: a leader lies in the same node above
        assert (own[np.unique(above)] == np.unique(above)).all() or level == 0  # a leader leads below too
        above = own


def test_registered_query(spark):
    rows = queries.op8_embedding_near_dup(spark, "/root/testdata/sf0.01").collect()
    vectors = {r.vec_id: r.embedding for r in queries.table(spark, "/root/testdata/sf0.01", "embeddings").collect()}
    ids = sorted(vectors)
    want = brute([vectors[i] for i in ids])
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == {i: (n, ids[c]) for i, (n, c) in zip(ids, want)}
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
