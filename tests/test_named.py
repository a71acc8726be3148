"""Syncs, compaction and change feeds of large states: wide rows are picked by key and not shuffled."""

import glob

import pytest

from quaero.plans import changes as CH
from quaero.plans import index as IX
from quaero.plans import named as N

KEPT = ("id", "url", "content", "content_hash")


def chunks(spark, texts):
    return spark.createDataFrame([(i, "u", t) for i, t in texts.items()], "id long, url string, content string")


def shuffled(df):
    """The output columns below the shuffles of a plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


@pytest.mark.parametrize("most", [N.MOST_KEYS, 0, 3])
@pytest.mark.parametrize("wanted", [[], [1], [0, 1, 2, 3, 4, 6, 7, 8, 9], list(range(12)), [3, 3, 99, None]])
def test_rows_named_by_key(spark, wanted, most):
    rows = spark.createDataFrame([(i % 10, f"t{i}") for i in range(20)] + [(None, "n")], "id long, text string")
    keys = spark.createDataFrame([(w,) for w in wanted], "id long")
    got = sorted(r.text for r in N.named(rows, ["id"], keys, most).collect())
    assert got == sorted(f"t{i}" for i in range(20) if i % 10 in wanted)


@pytest.fixture(scope="module")
def synced(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('synced')}/index"
    first = {i: f"text {i} of many" for i in range(60)}
    second = {i: (t.upper() if i % 3 else t) for i, t in first.items() if i % 10} | {100: "new"}
    third = {i: t + " more" if i == 7 else t for i, t in second.items()}
    for n, state in enumerate((first, second, third)):
        IX.sync_index(chunks(spark, state), path, n)
    return path, first, second, third


def texts(df):
    return {r.id: r.content for r in df.collect()}


def test_states_of_all_syncs(spark, synced):
    path, *states = synced
    for n, state in enumerate(states):
        assert texts(IX.current_rows(spark, path, n + 1, KEPT)) == state
    index = IX.load_index(spark, path)
    assert index.stats.rows == len(states[-1])
    want = IX.build_index(chunks(spark, states[-1]), vectors=False).stats
    assert {tuple(r) for r in index.stats.terms.collect()} == {tuple(r) for r in want.terms.collect()}


def test_the_state_is_read_without_a_shuffle_of_its_texts(spark, synced):
    """What two thirds of the rows were superseded by was joined to all texts, both shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for keys of 6 GB of texts
    try:
        path, first, second, third = synced
        state = IX.current_rows(spark, path, columns=KEPT)
        assert texts(state) == third and not shuffled(state)
        fed = CH.apply_changes(IX.current_rows(spark, path, before=1, columns=KEPT), CH.changes(spark, path, after=0))
        assert texts(fed) == third and not shuffled(fed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_compaction_keeps_the_state_and_syncs_leave_no_copies(spark, synced, folder):
    path, *_, third = synced
    assert texts(IX.compact(spark, path, f"{folder}/compact")) == third
    place = f'{spark.conf.get("spark.checkpoint.dir")}/sync-*/*'
    before = set(glob.glob(place))  # what refused syncs left
    IX.sync_index(chunks(spark, third), f"{folder}/compact")
    assert set(glob.glob(place)) == before


def test_a_sync_of_more_keys_than_are_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(IX, "MOST_KEYS", 2)
    monkeypatch.setattr(N, "MOST_KEYS", 2)
    first = {i: f"a {i}" for i in range(9)}
    second = {i: f"b {i}" if i < 6 else t for i, t in first.items() if i != 8} | {20: "n"}
    for n, (state, want) in enumerate(((first, {"insert": 9}), (second, {"insert": 1, "update": 6, "delete": 1}))):
        assert {r.op: r.rows for r in IX.sync_index(chunks(spark, state), f"{folder}/index", n).collect()} == want
    assert texts(IX.current_rows(spark, f"{folder}/index")) == second
