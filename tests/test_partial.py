"""Searches, fetches and comparisons that read a part of the index: same results, fewer rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaero.operators import chunk as C
from quaero.operators import vector as V
from quaero.operators.cells import build_cells, cells_topk
from quaero.operators.keyword import hybrid_topk, keyword_topk, weighted_queries
from quaero.operators.models import apply_model
from quaero.operators.numbering import dense_numbers
from quaero.operators.postings import build_postings, postings_search
from quaero.operators.scoring import Skyband
from quaero.params import Params
from quaero.plans import changes as CH
from quaero.plans import deadletters as DL
from quaero.plans import identity as ID
from quaero.plans import index as IX
from quaero.plans.digests import differing_ranges, range_diff, range_digests
from quaero.plans.retrieve import in_ranges, payload, retrieve


def rows_of(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


def passages(spark, n=900, seed=1):
    """Pages on topics of their own: a page's passages share words, one word is in all of them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        page = i // 15
        own = [f"w{page}x{rng.integers(6)}" for _ in range(rng.integers(0, 12))]
        rows.append((i, f"u{page:04}", " ".join(["the"] * int(rng.integers(1, 4)) + own + [f"c{rng.integers(40)}"])))
    rows += [(n + i, "copy", rows[20][2]) for i in range(60)]
    return spark.createDataFrame(rows, "id long, url string, content string")


def questions(spark):
    asked = ["the w3x1 w3x2 w3x4", "w20x0 c7 the", "the", "c1 c2 c3 the", "nothing known", "", "w41x5 w41x1 w5x2"]
    return spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")


@pytest.mark.parametrize("params", [Params(part_rows=256, shard_rows=16, seed_shards=2),
                                    Params(part_rows=100, shard_rows=7, seed_shards=1, pushed_terms=0, tile_cells=50)])
def test_postings_give_the_hits_of_a_whole_scan(spark, params):
    index = IX.build_index(passages(spark), params, vectors=False, postings=True)
    asked = questions(spark)
    want = rows_of(keyword_topk(index.rows, asked, index.stats, 10, params))
    assert rows_of(retrieve(asked, index, 10, mode="keyword", params=params)) == want
    assert rows_of(retrieve(asked, index, 10, mode="keyword", params=params, where={"url": "copy"})) == \
        rows_of(keyword_topk(index.rows, asked, index.stats, 10, params, where={"url": "copy"}))


def test_postings_read_few_shards_for_rare_words(spark):
    params = Params(part_rows=256, shard_rows=16, seed_shards=2)
    index = IX.build_index(passages(spark), params, vectors=False, postings=True)
    rare = questions(spark).where("query_id in (0, 6)")
    found = postings_search(index.postings, weighted_queries(rare, index.stats), 5)
    assert found.hits.count() == 10 and found.shards >= 55 and found.read <= 12
    every = postings_search(index.postings, weighted_queries(questions(spark).where("query_id = 2"), index.stats), 5)
    assert every.hits.count() == 5 and every.read <= every.shards


def test_empty_postings(spark):
    none = spark.createDataFrame([], "id long, url string, content string")
    index = IX.build_index(none, vectors=False, postings=True)
    assert retrieve(questions(spark), index, 5, mode="keyword").count() == 0


def test_blocks_of_a_frequent_word_are_bounded(spark):
    params = Params(part_rows=256, shard_rows=16)
    rows = IX.with_terms(passages(spark))
    blocks = build_postings(rows, 5.0, params).blocks(spark)
    sizes = blocks.select("term", F.size("ids").alias("n"), (F.array_max("impacts") == F.col("most")).alias("bound")).collect()
    assert max(r.n for r in sizes) <= 16 and all(r.bound for r in sizes)
    assert sum(r.n for r in sizes if r.term == "the") == rows.count()


def test_blocks_are_written_many_to_a_row(spark):
    params = Params(part_rows=256, shard_rows=16, page_postings=64)
    rows = IX.with_terms(passages(spark))
    postings = build_postings(rows, 5.0, params)
    many = rows.select(F.explode(F.array_distinct("terms"))).count()
    assert spark.read.parquet(postings.path).count() <= many / 48 + 8 and postings.blocks(spark).count() >= many / 4
    want = {(r.term, r.id) for r in rows.select(F.explode("terms").alias("term"), "id").collect()}
    got = [(r.term, r.id) for r in postings.blocks(spark).select("term", F.explode("ids").alias("id")).collect()]
    assert len(got) == len(want) == many and set(got) == want
    for page in postings.pages(spark).collect():
        assert (page.first, page.last) == (min(page.terms), max(page.terms)) and page.terms == sorted(set(page.terms))


@pytest.mark.parametrize("more", [dict(run_terms=1, page_postings=1), dict(run_terms=40, page_postings=3), dict(pushed_terms=0)])
def test_runs_and_pages_of_any_size_give_the_same_hits(spark, more):
    params = Params(part_rows=128, shard_rows=16, seed_shards=2, **more)
    index = IX.build_index(passages(spark), params, vectors=False, postings=True)
    asked = questions(spark)
    assert rows_of(retrieve(asked, index, 10, mode="keyword", params=params)) == \
        rows_of(keyword_topk(index.rows, asked, index.stats, 10, params))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    data = np.vstack([centres[i % 40] + 0.3 * rng.normal(size=24) for i in range(3000)]).astype(np.float32)
    return data


def vectors(spark, matrix, id_):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{id_} long, embedding array<float>")


def test_cells_reach_the_target_recall_with_few_rows(spark, clustered):
    rows, asked = vectors(spark, clustered, "id"), vectors(spark, clustered[::60], "query_id")
    cells = build_cells(rows, Params(cell_sample=1500, cell_queries_measured=60))
    exact = rows_of(V.vector_topk(rows, asked, 20))
    near = rows_of(cells_topk(cells, asked, 20))
    for k in (5, 20):
        true = {(q, i) for q, r, i, _ in exact if r <= k}
        got = {(q, i) for q, r, i, _ in near if r <= k}
        assert len(true & got) >= 0.9 * len(true)
    share = np.sort(cells.sizes)[::-1][:cells.probes].sum() / cells.sizes.sum()
    assert share <= 0.35 and cells.recall >= 0.95 and cells.sizes.sum() == 3000
    assert rows_of(cells_topk(cells, asked, 20, exact=True)) == exact
    assert rows_of(cells_topk(cells, asked, 20, threshold=0.97, exact=True)) == [r for r in exact if r[3] >= 0.97]
    index = IX.Index(rows, None, cells=cells)
    assert rows_of(retrieve(asked, index, 20, mode="ann")) == near


def test_cells_without_structure_or_rows(spark):
    rng = np.random.default_rng(4)
    loose = rng.normal(size=(400, 16)).astype(np.float32)
    loose[50:200] = loose[0]  # copies
    rows, asked = vectors(spark, loose, "id"), vectors(spark, loose[::40], "query_id")
    cells = build_cells(rows)
    assert rows_of(cells_topk(cells, asked, 10, exact=True)) == rows_of(V.vector_topk(rows, asked, 10))
    none = build_cells(rows.limit(0))
    assert cells_topk(none, asked, 5).count() == 0


def scan_rows(df):
    """Rows that the scans of an executed plan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_rare_word_reads_few_rows_of_a_part(spark):
    rows = IX.with_terms(passages(spark).coalesce(1))
    pages = build_postings(rows, 5.0, Params(page_postings=1)).pages(spark)
    some = pages.where("first <= 'w3x1' AND last >= 'w3x1'")
    assert scan_rows(some.select("part", "terms", "blocks")) <= 0.5 * pages.count() and pages.count() >= 400
    assert all(r.terms == ["w3x1"] for r in some.collect())


def test_lookup_reads_the_row_groups_of_the_hits(spark):
    params = Params(lookup_group_bytes=2000)
    rows = spark.range(0, 40_000, 1, 4).selectExpr("id * 7 AS id", "'u' AS url", "repeat(md5(cast(id AS string)), 3) AS content")
    index = IX.build_index(rows, params, vectors=False, lookup=True)
    hits = spark.createDataFrame([(1, 7 * i) for i in (3, 4, 9000, 30_001, 39_999)] + [(2, 7 * 9000)], "query_id long, id long")
    got = payload(hits, index, ("content",), params)
    want = hits.join(index.rows.select("id", "content"), "id")
    assert sorted(map(tuple, got.select("query_id", "id", "content").collect())) == \
        sorted(map(tuple, want.select("query_id", "id", "content").collect()))
    # Row groups and pages outside the ranges are not read.
    assert scan_rows(in_ranges(index.lookup, hits, params).select("id", "content")) <= 8000
    assert in_ranges(index.lookup, hits, Params(lookup_ids=2)).count() == 40_000
    assert in_ranges(index.lookup, hits.limit(0), params).count() == 0


@pytest.mark.parametrize("weight", [0.5, 0.9, 0.2, 0.0])
def test_one_scan_blends_like_two(spark, weight):
    """The way of two scans is the one that larger query sets take."""
    rows = passages(spark, 300)
    index = IX.build_index(rows)
    some = index.rows.withColumn("embedding", F.when(F.col("id") % 4 > 0, F.col("embedding")))
    asked = V.embed(questions(spark), "text")
    one, two = Params(vector_weight=weight, tile_cells=700), Params(vector_weight=weight, broadcast_queries=0, cell_rows=70, cell_queries=3)
    for threshold in (None, 0.6):
        a = rows_of(hybrid_topk(some, asked, index.stats, 8, one, threshold=threshold))
        assert a == rows_of(hybrid_topk(some, asked, index.stats, 8, two, threshold=threshold)) and a


def test_skyband_holds_the_best_for_every_divisor():
    rng = np.random.default_rng(6)
    for trial in range(30):
        n, k, w = 300, 5, 0.5
        cos = np.round(rng.random((2, n)), int(rng.integers(1, 4)))
        lex = np.where(rng.random((2, n)) < 0.3, np.round(10 * rng.random((2, n)), int(rng.integers(0, 3))), 0.0)
        ids = rng.permutation(n)
        band = Skyband(2, k, 1e-4 / w)
        for at in range(0, n, 37):
            part = slice(at, at + 37)
            band.add(ids[part], cos[:, part], lex[:, part], np.ones_like(cos[:, part], bool))
        import pyarrow as pa

        held = band.batch(pa.array([0, 1])).to_pandas()
        for q in range(2):
            kept = set(held[held.query_id == q].id)
            for best in (lex[q].max(), lex[q].max() * 2, 100.0, 0.01):
                score = np.round(w * cos[q] + (1 - w) * lex[q] / max(best, 1e-9), 4) if best else np.round(w * cos[q], 4)
                if best >= lex[q].max():
                    top = sorted(zip(-score, ids))[:k]
                    assert {i for _, i in top} <= kept


def test_dense_numbers_follow_the_order_without_gaps(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "id * 37 % 101 AS k")
    got = dense_numbers(df, ["k", "id"], "n", 50).orderBy("n").collect()
    assert [r.n for r in got] == list(range(50, 1050))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert dense_numbers(df.limit(0), ["id"]).count() == 0


def test_ids_are_given_once_and_survive_a_repeated_batch(spark, folder):
    path = folder + "/ids"
    rows = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, t string")
    ids = lambda df: {r.t: r.id for r in df.collect()}
    first = ids(ID.assign_ids(rows("a", "b", "a", None), path, ["t"], 0))
    assert sorted(first.values()) == [0, 1, 2]
    second = ids(ID.assign_ids(rows("b", "c", "d", ""), path, ["t"], 1))
    assert second["b"] == first["b"] and sorted(second.values())[1:] == [3, 4, 5]
    assert ids(ID.assign_ids(rows("b", "c", "d", ""), path, ["t"], 1)) == second  # tried again
    assert ID.next_id(spark, path) == 6
    third = ids(ID.assign_ids(rows("a", "e"), path, ["t"], 2))
    assert third == {"a": first["a"], "e": 6}
    assert ID.assign_ids(rows().limit(0), path, ["t"], 3).count() == 0 and ID.next_id(spark, path) == 7


def chunks(spark, **texts):
    return spark.createDataFrame([(int(i[1:]), "u", t) for i, t in texts.items()], "id long, url string, content string")


def test_change_feed_shows_rows_before_and_after(spark, folder):
    path = folder + "/index"
    states = [dict(c1="a", c2="b", c3="c"), dict(c1="a", c2="B", c4="d"), dict(c1="a", c2="BB", c3="c"), dict(c1="x")]
    for i, s in enumerate(states):
        IX.sync_index(chunks(spark, **s), path, i)
    feed = lambda *at: sorted((r.batch_id, r.id, r.change, r.content) for r in CH.changes(spark, path, *at).collect())
    assert feed(0, 1) == [(1, 2, "update_after", "B"), (1, 2, "update_before", "b"), (1, 3, "delete", "c"), (1, 4, "insert", "d")]
    assert feed(1, 2) == [(2, 2, "update_after", "BB"), (2, 2, "update_before", "B"), (2, 3, "insert", "c"), (2, 4, "delete", "d")]
    assert [f[1:] for f in feed(None, 0)] == [(1, "insert", "a"), (2, "insert", "b"), (3, "insert", "c")] and feed(3) == []
    columns = ("id", "url", "content", "content_hash")
    for start in range(3):
        for end in range(start, 4):
            state = IX.current_rows(spark, path, before=start + 1, columns=columns)
            made = CH.apply_changes(state, CH.changes(spark, path, start, end))
            assert {r.id: r.content for r in made.collect()} == {int(i[1:]): t for i, t in states[end].items()}


def test_change_stream_feeds_a_second_consumer(spark, folder):
    path, seen = folder + "/index", []
    IX.sync_index(chunks(spark, c1="a", c2="b"), path, 0)

    def take():
        (CH.change_stream(spark, path).writeStream.foreachBatch(lambda df, n: seen.extend((r.batch_id, r.id, r.op, r.content) for r in df.collect()))
            .option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start().awaitTermination())

    take()
    assert sorted(seen) == [(0, 1, "insert", "a"), (0, 2, "insert", "b")]
    seen.clear()
    IX.sync_index(chunks(spark, c1="A"), path, 1)
    take()
    assert sorted(seen, key=str) == [(1, 1, "update", "A"), (1, 2, "delete", None)]


def test_digests_find_the_ranges_that_differ(spark):
    old = IX.with_hash(spark.range(20_000).selectExpr("id", "'u' AS url", "'t' || id AS content"))
    new = IX.with_hash(spark.range(1, 20_100).selectExpr("id", "'u' AS url", "if(id between 700 and 900, 'x', 't' || id) AS content"))
    stored = range_digests(old, 100)
    ranges = {r.range for r in differing_ranges(stored, range_digests(new, 100)).collect()}
    assert ranges == {0, 7, 8, 9, 200}  # 1 % of the rows change: 5 of 201 ranges are read
    for deletes in (True, False):
        got = {(r.id, r.op) for r in range_diff(old, stored, new, 100, deletes).collect()}
        assert got == {(r.id, r.op) for r in IX.index_diff(old, new, deletes).collect()}
    assert range_diff(old, stored, old, 100).count() == 0
    # Sums over the rows: the digests of what is added make up for those of what is not there.
    parts = [range_digests(old.where(c), 100) for c in ("id % 3 = 0", "id % 3 > 0")]
    both = parts[0].unionByName(parts[1]).groupBy("range").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))
    assert differing_ranges(stored, both).count() == 0


def test_letters_wait_longer_each_time_and_close(spark, folder):
    sent = []

    def model():
        def call(batch):
            if (batch["attempts"] < 3).any():
                raise RuntimeError("not yet")
            return pd.DataFrame({"tag": ["ok"] * len(batch)})
        return call

    work = lambda rows: apply_model(rows, model, "tag string", attempts=1)
    rows = spark.createDataFrame([(1, "a", None, 0), (2, None, 2.5, 0)], "id long, t string, v double, attempts int")
    DL.post(work(rows), folder + "/q", "tag", "id", 0, now=0, pause=10)
    replay = lambda run, now: [tuple(r) for r in DL.replay(
        spark, folder + "/q", "tag", "id long, t string, v double", "id", work, run, now, 10).collect()]
    assert replay(1, 9) == []
    assert {r.next_try for r in DL.letters(spark, folder + "/q").collect()} == {10}
    assert replay(2, 10) == [] and {(r.attempts, r.next_try, r.error) for r in DL.letters(spark, folder + "/q").collect()} == {
        (2, 30, "RuntimeError: not yet")}
    assert replay(3, 29) == [] and replay(4, 30) == []
    assert sorted(replay(5, 70)) == [(1, "a", None, "ok"), (2, None, 2.5, "ok")]
    assert sorted(replay(5, 70)) == [(1, "a", None, "ok"), (2, None, 2.5, "ok")]  # the run again, as after a failure
    assert replay(6, 10_000) == [] and not sent
    assert {(r.attempts, r.done) for r in DL.letters(spark, folder + "/q").collect()} == {(4, True)}


def test_long_texts_split_in_linear_time(spark):
    lines = spark.createDataFrame([("\n".join(f"word{i} of line" for i in range(20_000)),)], "t string")
    lines.select(C.recursive_split("t", 64, 8)).collect()
    at = time.perf_counter()
    cut = lines.select(C.recursive_split("t", 512, 50).alias("c")).first().c
    assert time.perf_counter() - at < 3.0
    assert len(cut) > 100 and cut[0].startswith("word0 of line")


def brute_pack(sizes, size, overlap):
    """First and number of the atoms of each chunk."""
    out, lo = [], 0
    for i in range(len(sizes)):
        if sum(sizes[lo:i + 1]) > size:
            out.append((lo, i - lo))
            lo = next(s for s in range(lo + 1, i + 1) if sum(sizes[s:i]) <= overlap and sum(sizes[s:i + 1]) <= size)
    return [*out, (lo, len(sizes) - lo)]


def test_chunks_overlap_as_far_as_they_fit(spark):
    rng = np.random.default_rng(8)
    for size, overlap in ((12, 4), (7, 0), (20, 19)):
        sizes = [int(x) for x in rng.integers(1, 7, 120)]
        lines = [" ".join(["w"] * n) + "\n" for n in sizes]
        got = spark.createDataFrame([("".join(lines),)], "t string").select(C.recursive_split("t", size, overlap).alias("c")).first().c
        assert got == ["".join(lines[a:a + n]).strip() for a, n in brute_pack(sizes, size, overlap)]
