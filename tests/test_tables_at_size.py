"""Tables as larger copies come: folders of files, URLs and ids that repeat, more rows than one tile."""

import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quaero.operators.cells import build_cells, cells_topk
from quaero.operators.scoring import TermKernel, VectorKernel, best_of
from quaero.operators.topk import _pieces, _tasks, grid_topk
from quaero.operators.vector import hashed_vector
from quaero.params import Params
from quaero.plans.corpus import build_corpus, searched
from quaero.plans.index import build_index
from quaero.sources.tables import stream_table
from quaero.streaming.answers import read_answers


def test_streams_read_tables_that_are_files_or_folders(spark, folder):
    rows = spark.createDataFrame([(c, t, "user", f"text {c} {t}") for c in range(6) for t in range(2)],
                                 "conv_id long, turn long, role string, text string")
    place = f"{folder}/many"
    rows.write.parquet(f"{place}/conversations.parquet")
    rows.toPandas().to_parquet(f"{folder}/conversations.parquet", index=False)
    for at in (place, folder):
        out = f"{at}/out"
        (stream_table(spark, at, "conversations").writeStream.format("parquet").option("checkpointLocation", f"{at}/marks")
            .trigger(availableNow=True).start(out).awaitTermination())
        assert spark.read.parquet(out).count() == 12


def test_answers_of_no_batch_are_no_rows(spark, folder):
    assert read_answers(spark, f"{folder}/none").count() == 0


def test_equal_passages_of_pages_with_one_url_are_indexed_once(spark):
    html = "<html><head><title>t</title></head><body><article><h1>t</h1><p>%s</p></article></body></html>"
    words = " ".join(f"word{i}" for i in range(40))
    pages = spark.createDataFrame([(i, "http://a/x", html % words + "<i>%d</i>" % i) for i in range(2)],
                                  "page_id long, url string, html string")
    corpus = build_corpus(pages, None, Params(heading_tag="p"), context=False)
    assert corpus.count() == 2 * corpus.select("id").distinct().count() > 0
    index = build_index(searched(corpus), vectors=False)
    assert index.rows.select("id").distinct().count() == index.rows.count() > 0


def _exact(index, queries, k):
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (queries, index))
    scores = np.round(a @ b.T, 6)
    return {(q, i, scores[q, i]) for q in range(len(queries)) for i in sorted(range(len(index)), key=lambda i: (-scores[q, i], i))[:k]}


def _vectors(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<float>")


def test_pieces_of_the_grid_do_not_grow_with_the_square_of_the_input(spark):
    """Each row went to a cell for every ``cell_queries`` queries; now to as many as there are tasks."""
    x = np.random.default_rng(1).normal(size=(4000, 4)).astype(np.float32)
    index, queries = _vectors(spark, x, "id"), _vectors(spark, x, "query_id")
    kernel, grid = VectorKernel(False), Params(broadcast_queries=0, cell_rows=20, cell_queries=20)
    named = index.select("id", F.lit(0).alias("bucket"), F.col("embedding").alias("i_embedding"))
    asked = queries.select("query_id", F.lit(0).alias("bucket"), F.col("embedding").alias("q_embedding"))
    cells = _pieces(named, asked, kernel, 3, grid, False)(named.limit(1)).first()
    assert cells.row_cells * cells.query_cells <= 2 * _tasks(index) < 200 * 200
    got = {(r.query_id, r.id, r.score) for r in grid_topk(index, queries, kernel, 3, grid).collect()}
    assert got == _exact(x.astype(float), x.astype(float), 3)


def test_exact_search_of_cells_sends_no_pair_of_query_and_cell(spark, folder):
    """The second search wrote a row with its vector for each query and cell."""
    x = np.random.default_rng(2).normal(size=(900, 16)).astype(np.float32)
    index, queries = _vectors(spark, x, "id"), _vectors(spark, x, "query_id")
    cells = build_cells(index, folder=folder)
    place = f'{spark.conf.get("spark.checkpoint.dir")}/*/*'
    before = set(glob.glob(place))
    got = {(r.query_id, r.id, r.score) for r in cells_topk(cells, queries, 5, normalised=False, exact=True).collect()}
    written = [spark.read.parquet(p).count() for p in set(glob.glob(place)) - before]
    assert got == _exact(x.astype(float), x.astype(float), 5)
    assert written and max(written) <= 5 * 900


def test_a_tile_of_many_queries_scores_as_one_of_few(spark):
    """Hits of all queries were sorted again for every 64 rows; blocks of queries keep their own."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    lists = [list(rng.choice(words, rng.integers(0, 25))) for _ in range(500)]
    asked = [sorted(set(rng.choice(words, 6))) for _ in range(300)]
    queries = pa.table({"query_id": range(300), "terms": asked, "weights": [[0.5 + len(t) for t in q] for q in asked]})
    batch = pa.RecordBatch.from_pydict({"id": range(500), "terms": lists})
    kernel = TermKernel(12.0, 1.2, 0.75)
    few = pa.Table.from_batches(best_of([batch], queries, kernel, 4, None, 64 * 7))
    many = pa.Table.from_batches(best_of([batch], queries, kernel, 4, None, 10 ** 7))
    order = [("query_id", "ascending"), ("score", "descending"), ("id", "ascending")]
    assert few.sort_by(order).equals(many.sort_by(order))
    raw = np.round(kernel.raw(kernel.block(queries), batch), 4)
    want = [(q, i, raw[q, i]) for q in range(300) for i in sorted(range(500), key=lambda i: (-raw[q, i], i))[:4] if raw[q, i] > 0]
    assert want == list(zip(*(many.sort_by(order)[c].to_pylist() for c in ("query_id", "id", "score"))))


def test_terms_are_hashed_as_the_formula_says(spark):
    df = spark.createDataFrame([(["ab", "c", "ab"],), ([],), (None,)], "t array<string>")
    place = F.transform("t", lambda t: (F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("bigint") % 16).cast("int"))
    for row in df.select(hashed_vector("t", 16).alias("v"), place.alias("p")).collect():
        if row.p is None:
            assert row.v is None
        else:
            counts = np.bincount(np.array(row.p, int), minlength=16)
            assert np.allclose(row.v, counts / max(1, np.linalg.norm(counts)))


def test_a_pair_that_comes_twice_is_one_hit_of_the_grid_and_of_cells(spark, folder):
    x = np.random.default_rng(6).normal(size=(120, 4)).astype(np.float32)
    index, queries = (_vectors(spark, x, name) for name in ("id", "query_id"))
    index, queries = index.unionByName(index.where("id % 3 = 0")), queries.unionByName(queries.where("query_id % 5 = 0"))
    want = _exact(x.astype(float), x.astype(float), 6)
    grid = grid_topk(index, queries, VectorKernel(False), 6, Params(cell_rows=50, cell_queries=50))
    probed = cells_topk(build_cells(index, folder=folder), queries, 6, normalised=False, exact=True)
    for hits in (grid, probed):
        found = [(r.query_id, r.id, r.score) for r in hits.collect()]
        assert len(found) == len(set(found)) and set(found) == want
