import datetime as dt
import json
import random

import pytest
from weirflow.operators.changes import compute_changes, row_diff
from weirflow.operators.merges import merged, replaced
from weirflow.operators.tables import Model, Table, TableStore
from weirflow.plans.projection import Declared

T0 = dt.datetime(2026, 1, 1)
COLS = [Declared("k", "int", key=True), Declared("v", "string")]


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t")


def load(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


def got(df, *c):
    return sorted((tuple(r) for r in (df.select(*c) if c else df).collect()), key=repr)


def test_full_refresh_and_keys(spark, table):
    model = Model("table")
    r = table.materialize(load(spark, [(1, "a"), (2, "b")]), model, COLS, now=T0)
    assert r == {"rows_loaded": 2, "table_created": True, "schema_updated": False, "materialization_type": "table"}
    table.materialize(load(spark, [(3, "c")]), model, COLS, now=T0)
    assert got(table.read()) == [(3, "c")]
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            table.materialize(load(spark, bad), model, COLS, now=T0)
    assert got(table.read()) == [(3, "c")]
    assert table.vacuum() >= 1 and got(table.read()) == [(3, "c")]


def test_incremental(spark, table):
    merge = Model("incremental", ["k"], "merge")
    table.materialize(load(spark, [(i, "old") for i in range(20)]), merge, COLS, now=T0)
    table.materialize(load(spark, [(3, "x"), (3, "y"), (50, "new")]), merge, COLS, now=T0)
    rows = dict(got(table.read()))
    assert len(rows) == 21 and rows[3] == "y" and rows[50] == "new" and rows[4] == "old"
    table.materialize(load(spark, [], "k long, v string"), merge, COLS, now=T0)
    assert len(got(table.read())) == 21
    table.materialize(load(spark, [(60, "p")]), Model("incremental"), COLS, now=T0)
    with pytest.raises(ValueError, match="repeated keys"):
        table.materialize(load(spark, [(60, "p")]), Model("incremental"), COLS, now=T0)
    table.materialize(load(spark, [(4, "a"), (4, "b"), (60, "q")]), Model("incremental", "k", "delete+insert"), COLS, now=T0)
    rows = got(table.read())
    assert len(rows) == 23 and (4, "a") in rows and (4, "b") in rows and (60, "q") in rows and (60, "p") not in rows


def files_of(table):
    from pathlib import Path

    return {p: p.stat().st_mtime_ns for p in Path(table.path.removeprefix("file://")).rglob("*.parquet")}


def test_a_small_upsert_writes_little(spark, table):
    merge = Model("incremental", ["k"], "merge")
    table.materialize(spark.range(1_000_000).selectExpr("id AS k", "cast(id AS string) AS v"), merge, COLS, now=T0)
    before = files_of(table)
    table.materialize(spark.range(64).selectExpr("id * 15000 AS k", "'new' AS v"), merge, COLS, now=T0)
    after = files_of(table)
    assert {p: t for p, t in after.items() if p in before} == before
    assert sum(p.stat().st_size for p in after.keys() - before.keys()) < 0.01 * sum(p.stat().st_size for p in before)
    m = table.manifest()
    assert (m.rows, m.gone_rows) == (1_000_064, 64)
    assert table.read().count() == 1_000_000 and table.read().filter("v = 'new'").count() == 64


def test_closed_versions_are_not_written_again(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/h", loose=0.6)
    model = Model("snapshot", ["k"], strategy="check", check_cols=["v"])
    for step in range(3):
        before = files_of(table)
        table.materialize(load(spark, [(k, str(step if k < 5 else 0)) for k in range(100)]), model, now=T0 + dt.timedelta(days=step))
        assert all(files_of(table)[p] == t for p, t in before.items())
    m = table.manifest()
    assert (len(m.data), len(m.closed), m.gone_rows) == (3, 2, 10)
    rows = table.read()
    assert rows.count() == 110 and rows.filter("is_current").count() == 100


def test_a_write_that_was_overtaken_is_refused(spark, table):
    other = Table(spark, table.path)
    table.materialize(load(spark, [(1, "a")]), Model("table"), now=T0)
    stage = other._stage

    def slow(*args, **kwargs):
        table.materialize(load(spark, [(2, "b")]), Model("incremental"), now=T0)
        return stage(*args, **kwargs)

    other._stage = slow
    with pytest.raises(RuntimeError, match="meanwhile"):
        other.materialize(load(spark, [(3, "c")]), Model("incremental"), now=T0)
    assert got(table.read()) == [(1, "a"), (2, "b")]


def test_compaction(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/c", loose=0.3)
    merge = Model("incremental", ["k"], "merge")
    for step in range(4):
        table.materialize(load(spark, [(k, f"{step}") for k in range(step, 10)]), merge, now=T0)
        assert dict(got(table.read())) == {k: str(min(k, step)) for k in range(10)}
        m = table.manifest()
        assert m.gone_rows <= 0.3 * m.rows and m.rows - m.gone_rows == 10
    table.vacuum()
    assert dict(got(table.read())) == {k: str(min(k, 3)) for k in range(10)}


def test_repeated_keys_of_a_merge_need_an_order(spark, table):
    merge = Model("incremental", ["k"], "merge")
    table.materialize(load(spark, [(1, "a")]), merge, now=T0)
    batch = load(spark, [(1, "x"), (2, "p"), (1, "z"), (1, "y")])
    with pytest.raises(ValueError, match="without order"):
        table.materialize(batch.repartition(3), merge, now=T0)
    assert got(table.read()) == [(1, "a")]
    table.materialize(batch.repartition(3).orderBy("v"), merge, now=T0)
    assert got(table.read()) == [(1, "z"), (2, "p")]
    table.materialize(batch.repartition(3), Model("incremental", ["k"], "merge", updated_at="v"), now=T0)
    assert got(table.read()) == [(1, "z"), (2, "p")]


def test_composite_keys(spark):
    a = load(spark, [(1, "x", 1), (1, "y", 2), (None, "x", 3)], "a int, b string, n int")
    b = load(spark, [(1, "y", 9), (2, "x", 4)], "a int, b string, n int")
    assert got(merged(a, b, ["a", "b"])) == sorted([(1, "x", 1), (1, "y", 9), (None, "x", 3), (2, "x", 4)], key=repr)
    assert got(replaced(a, b, ["a", "b"])) == got(merged(a, b, ["a", "b"]))


@pytest.mark.parametrize("hard", ["ignore", "invalidate", "new_record"])
@pytest.mark.parametrize("strategy", ["check", "timestamp"])
def test_history_against_a_row_by_row_model(spark, tmp_path, strategy, hard):
    r = random.Random(f"{hard}{strategy}")
    table = Table(spark, f"file://{tmp_path}/h")
    model = Model("snapshot", ["a", "b"], strategy=strategy, updated_at="at", check_cols=["v"], hard_deletes=hard)
    want: list[dict] = []
    for step in range(4):
        now = T0 + dt.timedelta(days=step)
        batch = {(k, "x"): (r.choice(["p", "q", None]), T0 + dt.timedelta(hours=r.randint(0, 50))) for k in r.sample(range(10), 7)}
        for key, (v, at) in batch.items():
            cur = next((w for w in want if w["key"] == key and w["cur"]), None)
            if cur and not (v != cur["v"] if strategy == "check" else at > cur["at"]):
                continue
            if cur:
                cur.update(cur=False, to=now)
            want.append({"key": key, "v": v, "at": at, "frm": now, "to": None, "cur": True, "del": False})
        if hard != "ignore":
            for w in want:
                if w["cur"] and w["key"] not in batch:
                    w.update({"cur": False, "to": now, "del": hard == "invalidate"})
        df = load(spark, [(a, b, v, at) for (a, b), (v, at) in batch.items()], "a int, b string, v string, at timestamp")
        table.materialize(df, model, now=now)
        assert got(table.read(), "a", "b", "v", "at", "valid_from", "valid_to", "is_current", "is_deleted") == sorted(((*w["key"], w["v"], w["at"], w["frm"], w["to"], w["cur"], w["del"]) for w in want), key=repr)
        current = table.read().filter("is_current")
        assert current.count() == current.select("a", "b").distinct().count()
    with pytest.raises(ValueError, match="repeated keys"):
        table.materialize(load(spark, [(1, "x", "p", T0)] * 2, "a int, b string, v string, at timestamp"), model, now=T0)


def test_schema_policies(spark, tmp_path):
    def fresh(policy):
        t = Table(spark, f"file://{tmp_path}/{policy}")
        t.materialize(load(spark, [(1, "a", 1)], "k long, v string, n long"), Model("incremental", on_schema_change=policy), now=T0)
        return t, load(spark, [(2, 7, "w")], "k long, v long, extra string"), Model("incremental", on_schema_change=policy)

    t, more, m = fresh("ignore")
    assert not t.materialize(more, m, now=T0)["schema_updated"] and got(t.read()) == [(1, "a", 1), (2, "7", None)]
    t, more, m = fresh("append_new_columns")
    assert t.materialize(more, m, now=T0)["schema_updated"] and got(t.read(), "k", "v", "n", "extra") == [(1, "a", 1, None), (2, "7", None, "w")]
    t, more, m = fresh("fail")
    with pytest.raises(ValueError, match="the schema changed"):
        t.materialize(more, m, now=T0)
    t, more, m = fresh("sync_all_columns")
    t.materialize(more, m, now=T0)
    assert got(t.read(), "k", "v", "n", "extra") == [(1, None, 1, None), (2, 7, None, "w")]


@pytest.mark.parametrize(
    "bad",
    [
        {"materialization": "snapshot"},
        {"materialization": "snapshot", "unique_key": "k"},
        {"materialization": "snapshot", "unique_key": "k", "strategy": "timestamp"},
        {"materialization": "snapshot", "unique_key": "k", "strategy": "check"},
        {"materialization": "snapshot", "unique_key": "k", "strategy": "check", "check_cols": "v"},
        {"materialization": "snapshot", "unique_key": "k", "strategy": "check", "check_cols": ["v"], "on_schema_change": "sync_all_columns"},
        {"materialization": "incremental", "incremental_strategy": "upsert"},
        {"materialization": "incremental", "incremental_strategy": "merge"},
        {"materialization": "view"},
    ],
)
def test_models_are_checked(bad):
    with pytest.raises(ValueError):
        Model(**bad)


def test_changes_are_logged_with_the_write(spark, table):
    m = Model("incremental", ["k"], "merge")
    table.materialize(load(spark, [(1, "a"), (2, None)]), m, COLS, now=T0, asset="t", run_id="r1", track=True)
    table.materialize(load(spark, [(1, "b"), (2, None), (3, "c")]), m, COLS, now=T0, asset="t", run_id="r2", track=True)
    table.materialize(load(spark, [(3, "c")]), Model("table"), COLS, now=T0, asset="t", run_id="r3", track=True)
    log = [(r["id"], r["op"], json.loads(r["pk"])["k"], r["before_data"] and json.loads(r["before_data"]), r["after_data"] and json.loads(r["after_data"]), r["run_id"]) for r in table.changes().orderBy("id").collect()]
    assert [x[0] for x in log] == list(range(1, len(log) + 1))
    assert log[:2] == [(1, "INSERT", 1, None, {"k": 1, "v": "a"}, "r1"), (2, "INSERT", 2, None, {"k": 2, "v": None}, "r1")]
    assert [x[1:] for x in log[2:]] == [("UPDATE", 1, {"v": "a"}, {"v": "b"}, "r2"), ("INSERT", 3, None, {"v": "c"}, "r2"), ("DELETE", 1, {"v": "b"}, None, "r3"), ("DELETE", 2, {"v": None}, None, "r3")]
    assert [r["id"] for r in table.pending(2, 3).collect()] == [3, 4, 5]
    table.materialize(load(spark, [(3, "c")]), m, COLS, now=T0, asset="t", run_id="r4", track=True, insert_only=True)
    assert table.pending(6, 100).count() == 1


def test_compute_changes(spark):
    old, new = load(spark, [(1, "a"), (2, "b"), (3, None)]), load(spark, [(2, "x"), (3, None), (4, "d")])
    assert got(compute_changes(new, old, ["k"]), "op", "pk") == [("DELETE", '{"k":1}'), ("INSERT", '{"k":4}'), ("UPDATE", '{"k":2}')]
    assert {r[0] for r in compute_changes(new, None, ["k"]).select("op").collect()} == {"INSERT"}


def test_row_diff(spark):
    old = load(spark, [(1, "a", 1), (1, "b", 2), (2, None, 1)], "k int, v string, t int")
    new = load(spark, [(1, "b", 3), (2, None, 1), (3, "c", 1), (3, "d", 2)], "k int, v string, t int")
    assert got(row_diff(new, old, ["k"], "t"), "k", "v", "change") == [(2, None, "changed"), (3, "d", "new")]


def test_store_names(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}")
    assert store.table("demo.orders").path.endswith("/demo/orders") and not store.table("a.b").exists()
    with pytest.raises(ValueError):
        store.table("../x")
    with pytest.raises(ValueError):
        store.table("a.b").read()
