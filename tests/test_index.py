"""Index upkeep, streams, sources and sinks."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaero.functions.keys import row_key
from quaero.plans import index as IX
from quaero.plans.retrieve import retrieve
from quaero.sources import tables as S
from quaero.sources.workdir import shared_dir, staged
from quaero.streaming.answers import answer_stream, read_answers
from quaero.streaming.sync import sync_stream

SCHEMA = "id long, url string, content string"


def chunks(spark, **texts):
    return spark.createDataFrame([(int(i[1:]), "u", t) for i, t in texts.items()], SCHEMA)


def state(spark, path):
    return {r.id: r.content for r in IX.current_rows(spark, path).collect()}


def ops(df):
    return {r.op: r["rows"] for r in df.collect()}


def test_sync_follows_inserts_updates_and_deletes(spark, folder):
    path = folder + "/index"
    assert ops(IX.sync_index(chunks(spark, c1="a", c2="b", c3="c"), path, 0)) == {"insert": 3}
    second = chunks(spark, c1="a", c2="B", c4="d")
    assert ops(IX.sync_index(second, path, 1)) == {"update": 1, "delete": 1, "insert": 1}
    assert state(spark, path) == {1: "a", 2: "B", 4: "d"}
    assert ops(IX.sync_index(second, path, 2)) == {}
    # A deleted passage comes back, and one changes twice.
    IX.sync_index(chunks(spark, c1="a", c2="BB", c3="c", c4="d"), path, 3)
    assert state(spark, path) == {1: "a", 2: "BB", 3: "c", 4: "d"}
    assert len(IX.current_rows(spark, path).select("id").collect()) == 4
    # The same sync again, as after a failure, changes nothing.
    assert ops(IX.sync_index(chunks(spark, c1="a", c2="BB", c3="c", c4="d"), path, 3)) == {
        "update": 1, "insert": 1}
    assert state(spark, path) == {1: "a", 2: "BB", 3: "c", 4: "d"}
    small = IX.compact(spark, path, folder + "/compact")
    assert {r.id: r.content for r in small.collect()} == {1: "a", 2: "BB", 3: "c", 4: "d"}


def test_what_makes_the_chunks_of_a_sync_runs_once(spark, folder):
    """It ran for the comparison and again for the rows that changed."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, "u", f"text {i}") for i in range(40)], SCHEMA).mapInArrow(count, SCHEMA)
    assert ops(IX.sync_index(rows, folder + "/i", 0)) == {"insert": 40}
    assert made.value == 40


def test_synced_index_can_be_searched(spark, folder):
    IX.sync_index(chunks(spark, c1="red cat", c2="blue dog"), folder + "/i", 0)
    index = IX.load_index(spark, folder + "/i")
    asked = spark.createDataFrame([(1, "dog")], "query_id long, text string")
    assert [r.id for r in retrieve(asked, index, 5, mode="keyword").collect()] == [2]


def test_counts_of_syncs_are_those_of_the_state(spark, folder):
    path = folder + "/index"
    steps = (dict(c1="red cat", c2="blue dog dog"), dict(c1="red dog", c3="a cat", c4=""), dict(c3="a cat"))

    def check(at):
        index = IX.load_index(spark, at)
        fresh = IX.corpus_stats(IX.current_rows(spark, at))
        as_map = lambda df: {r.term: r.df for r in df.collect()}
        assert as_map(index.stats.terms) == as_map(fresh.terms)
        assert (index.stats.rows, index.stats.avg_len) == (fresh.rows, pytest.approx(fresh.avg_len))

    for i, texts in enumerate([*steps, steps[-1]]):
        IX.sync_index(chunks(spark, **texts), path, min(i, 2))  # the last one once more
        check(path)
    IX.compact(spark, path, folder + "/compact")
    check(folder + "/compact")


def test_failed_embeddings_come_up_again(spark, folder):
    def embedder(broken):
        def model():
            def call(b):
                if b["content"].isin(broken).any():
                    raise RuntimeError("no vector")
                return pd.DataFrame({"embedding": [[1.0, 0.0]] * len(b)})
            return call
        return model

    rows = chunks(spark, c1="a", c2="b")
    path = folder + "/i"
    assert ops(IX.sync_index(rows, path, embedder=embedder(["b"]))) == {"insert": 2}
    assert [r.content for r in IX.failed_rows(spark, path).collect()] == ["b"]
    asked = spark.createDataFrame([(1, "b")], "query_id long, text string")
    assert [r.id for r in retrieve(asked, IX.load_index(spark, path), 5, mode="keyword").collect()] == [2]
    assert ops(IX.sync_index(rows, path, embedder=embedder([]))) == {"update": 1}
    assert IX.failed_rows(spark, path).count() == 0
    assert state(spark, path) == {1: "a", 2: "b"}
    index = IX.build_index(rows, embedder=embedder(["b"]))
    assert index.rows.count() == 2 and [r.id for r in index.failed.collect()] == [2]


def test_repeated_ids_are_refused(spark, folder):
    rows = chunks(spark, c1="a").union(chunks(spark, c1="b"))
    assert [(r.id, r["rows"], r.contents) for r in IX.id_conflicts(rows).collect()] == [(1, 2, 2)]
    with pytest.raises(ValueError, match="more than one row"):
        IX.build_index(rows)
    with pytest.raises(ValueError, match="more than one row"):
        IX.sync_index(rows, folder + "/i")


def test_stream_after_a_batch_keeps_all_rows(spark, folder):
    path = folder + "/index"
    IX.sync_index(chunks(spark, c1="a", c2="b", c3="c"), path)
    chunks(spark, c3="C", c4="d").write.parquet(folder + "/in/one")
    for checkpoint in ("/cp", "/cp", "/other"):  # a new checkpoint takes all files again
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(folder + "/in")
        sync_stream(source, path, folder + checkpoint).awaitTermination()
        assert state(spark, path) == {1: "a", 2: "b", 3: "C", 4: "d"}


def test_small_changes_do_not_shuffle_the_state(spark, folder):
    path = folder + "/index"
    IX.sync_index(spark.range(2000).selectExpr("id", "'u' AS url", "'t' || id AS content"), path)
    current = IX.current_rows(spark, path, columns=("id", "content_hash"))
    few = staged(IX.with_hash(chunks(spark, c1="x", c5000="y")), "few")
    diff = IX.index_diff(current, few, deletes=False)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.op) for r in diff.collect()} == {(1, "update"), (5000, "insert")}
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 0


def test_stream_gives_the_batch_result(spark, folder):
    first, second = chunks(spark, c1="a", c2="b"), chunks(spark, c2="b2", c3="c")
    first.write.parquet(folder + "/in/one")
    source = lambda: spark.readStream.schema(SCHEMA).option(
        "recursiveFileLookup", True).parquet(folder + "/in")
    run = lambda: sync_stream(source(), folder + "/index", folder + "/cp").awaitTermination()
    run()
    second.union(second).write.parquet(folder + "/in/two")
    run()
    assert state(spark, folder + "/index") == {1: "a", 2: "b2", 3: "c"}
    before = sorted(os.listdir(folder + "/index"))
    run()
    assert state(spark, folder + "/index") == {1: "a", 2: "b2", 3: "c"}
    assert sorted(os.listdir(folder + "/index")) == before == ["batch_id=0", "batch_id=1"]


def test_stream_answers_each_message_once(spark, folder):
    index = IX.build_index(chunks(spark, c1="The red cat sleeps.", c2="The dog barks."))
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "red cat"), (1, 0, "user", "red cat"), (1, 1, "assistant", "x")]
    spark.createDataFrame(rows, schema).write.parquet(folder + "/in/one")
    source = lambda: spark.readStream.schema(schema).option(
        "recursiveFileLookup", True).parquet(folder + "/in")
    run = lambda: answer_stream(source(), index, folder + "/out", folder + "/cp",
                                mode="keyword").awaitTermination()
    run()
    spark.createDataFrame([*rows, (2, 0, "user", "dog")], schema).write.parquet(folder + "/in/two")
    run()
    got = {r.question: r.answer for r in read_answers(spark, folder + "/out").collect()}
    assert got == {"red cat": "The red cat sleeps.", "dog": "The dog barks."}
    assert read_answers(spark, folder + "/out").count() == 2


def test_row_keys_are_stable_and_separate_fields(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x"), ("a", "bc")], "p string, q string")
    keys = [r[0] for r in df.select(row_key("p", "q")).collect()]
    assert keys[0] == keys[3] and len(set(keys)) == 3 and all(0 <= k < 2 ** 60 for k in keys)


def test_csv_sources(spark, folder):
    with open(folder + "/custom.csv", "w") as f:
        f.write('url,page_contents,content\n,,"a, ""b"""\n,,二行目\n')
    got = [tuple(r) for r in S.read_custom_passages(spark, folder + "/custom.csv").collect()]
    assert got == [("", "", 'a, "b"'), ("", "", "二行目")]
    with open(folder + "/eval.csv", "w") as f:
        f.write("request_id,request,expected_response\n1,q,one\\ntwo\n")
    row = S.read_eval_set(spark, folder + "/eval.csv").first()
    assert tuple(row) == ("1", "q", "one\ntwo")
    assert S.read_eval_set(spark, folder + "/eval.csv", unescape=False).first()[2] == "one\\ntwo"


def test_retrieval_log_keeps_other_runs(spark, folder):
    schema = ("run_id string, query_id long, rank int, id long, url string, score double, "
              "relevance_score double")
    row = lambda run, i: spark.createDataFrame([(run, 1, 1, i, "u", .5, None)], schema)
    S.append_log(row("a", 1), folder + "/log")
    S.append_log(row("b", 2), folder + "/log")
    got = S.append_log(row("a", 3), folder + "/log")
    assert {(r.run_id, r.id) for r in got.collect()} == {("a", 3), ("b", 2)}
    assert got.columns[0] == "run_id"


def test_unknown_catalog_is_refused(spark):
    with pytest.raises(ValueError):
        S.use_namespace(spark, "x", catalog="nowhere")


def test_stage_tables_go_to_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = staged(spark.range(3), "t")
    assert df.count() == 3 and all(shared_dir(spark) in f for f in df.inputFiles())


def test_csv_goes_by_header_and_reports_misfits(spark, folder):
    with open(folder + "/c.csv", "w") as f:
        f.write('content,more,url,page_contents\none,x,u,p\n"a, b",,v,\nshort,x\nlong,x,u,p,extra\n')
    path = folder + "/c.csv"
    got = {tuple(r) for r in S.read_custom_passages(spark, path).collect()}
    assert got == {("u", "p", "one"), ("v", "", "a, b")}
    assert {r.record for r in S.rejected_rows(spark, path).collect()} == {"short,x", "long,x,u,p,extra"}
    with open(folder + "/d.csv", "w") as f:
        f.write("url,content\nu,c\n")
    with pytest.raises(ValueError, match="page_contents"):
        S.read_custom_passages(spark, folder + "/d.csv")
