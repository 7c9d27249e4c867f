import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from weirflow.operators.attribute_history import runs, snapshot_history, update_history
from weirflow.operators.snapshot_diff import SnapshotStore, merge_runs, snapshot_changes

SNAP = "snap date, k1 string, k2 string, a string, b double, upd timestamp, key string, checked string"
DAYS = [dt.date(2026, 1, 1) + dt.timedelta(days=3 * i) for i in range(70)]


def fold(*k):
    return "|".join(x.strip(" \t").upper() for x in k)


def table(seed, days):
    r = random.Random(seed)
    rows = []
    for d in days:
        for k in range(25):
            if r.random() < 0.2:
                continue
            spelled = r.choice([f"k{k}", f"K{k}", f" K{k}\t"])
            for u in range(r.choice([1, 1, 2, 3])):
                rows.append((d, spelled, "X", r.choice(["p", "p", "P", None]), r.choice([1.0, 1.0, 2.5, None]), dt.datetime(2026, 1, 1, u), "c", "c"))
        rows += [(d, "hot", "Y", "p", 1.0, dt.datetime(2025, 1, 1), "c", "c")] * 40
    rows += [(None, "k1", "X", "p", 1.0, None, "c", "c"), (days[0], None, "X", "p", 1.0, None, "c", "c")]
    r.shuffle(rows)
    return rows


def picked(rows):
    best = {}
    for d, k1, k2, a, b, u, _, _ in rows:
        if None not in (d, k1, k2):
            key = (d, fold(k1, k2))
            if key not in best or u > best[key][0]:
                best[key] = (u, (a, b))
    return {k: v[1] for k, v in best.items()}


@pytest.mark.parametrize("seed", range(3))
def test_changes_against_brute_force(spark, seed):
    days = DAYS[:6]
    rows = table(seed, days)
    now = picked(rows)
    want = set()
    for p, d in zip(days, days[1:]):
        old, new = ({k: v for (x, k), v in now.items() if x == at} for at in (p, d))
        want |= {(k, d, "added") for k in new.keys() - old.keys()} | {(k, d, "removed") for k in old.keys() - new.keys()} | {(k, d, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    df = spark.createDataFrame(rows, SNAP)
    assert {tuple(r) for r in snapshot_changes(df, ["k1", "k2"], "snap", ["a", "b"], "upd").collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_history_against_brute_force(spark, seed):
    rows = table(seed, DAYS)
    now = picked(rows)
    want = set()
    for k in {k for _, k in now}:
        start = None
        for i, d in enumerate(DAYS):
            v = now.get((d, k), "absent")
            if start is not None and v != start[1]:
                want.add((k, start[0], d))
                start = None
            if start is None and v != "absent":
                start = (d, v)
        if start:
            want.add((k, start[0], None))
    df = spark.createDataFrame(rows, SNAP)
    got = [tuple(r) for r in snapshot_history(df, ["k1", "k2"], "snap", ["a", "b"], "upd").collect()]
    assert len(got) == len(set(got)) and set(got) == want


UPDATES = "acct string, at timestamp, amt double, ccy string, row_id long, key string, bucket int"


@pytest.mark.parametrize(("seed", "per_range"), [(0, 1_000_000), (1, 90), (2, 13)])
def test_update_history_against_brute_force(spark, seed, per_range):
    r = random.Random(seed)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(900):
        a = "hot" if r.random() < 0.4 else f"a{r.randint(0, 30)}"
        at = None if r.random() < 0.03 else t0 + dt.timedelta(minutes=r.randint(0, 3000))
        rows.append((r.choice([a, a.upper(), f" {a}"]), at, r.choice([1.0, 1.0, 1.0, 2.0, None]), r.choice(["E", "E", "E", None]), i, "c", 1))
    rows.append((None, t0, 1.0, "E", 5000, "c", 1))
    last = {}
    for a, at, amt, ccy, i, _, _ in rows:
        if a and at:
            last[fold(a), at] = max(last.get((fold(a), at), (-1, None)), (i, (amt, ccy)), key=lambda x: x[0])
    want = set()
    for k in {k for k, _ in last}:
        seq = sorted((t, v[1]) for (x, t), v in last.items() if x == k)
        starts = [t for n, (t, v) in enumerate(seq) if not n or seq[n - 1][1] != v]
        want |= {(k, a, b) for a, b in zip(starts, [*starts[1:], None])}
    got = [tuple(x) for x in update_history(spark.createDataFrame(rows, UPDATES), ["acct"], "at", ["amt", "ccy"], "row_id", per_range).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_merge_by_blocks(block):
    r = random.Random(block)
    for _ in range(30):
        old, new = ({f"k{r.randint(0, 40):03d}": r.choice("ab") for _ in range(r.randint(0, 40))} for _ in range(2))
        want = sorted([(k, "removed") for k in old.keys() - new.keys()] + [(k, "added") for k in new.keys() - old.keys()] + [(k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]])
        runs_ = [pa.array(x, pa.string()) for d in (old, new) for x in (sorted(d), [d[k] for k in sorted(d)])]
        got = [(k, c) for keys, kinds in merge_runs(*runs_, block=block) for k, c in zip(keys.to_pylist(), kinds.to_pylist())]
        assert sorted(got) == want


def test_snapshots_are_kept_sorted(spark, tmp_path):
    days = DAYS[:4]
    rows = table(5, days)
    df = spark.createDataFrame(rows, SNAP)
    want = {(k, str(d), c) for k, d, c in (tuple(r) for r in snapshot_changes(df, ["k1", "k2"], "snap", ["a", "b"], "upd").collect())}
    got = set()
    for d in days:
        store = SnapshotStore(spark, f"file://{tmp_path}/s", ["k1", "k2"], ["a", "b"], "upd")  # opened again for each delivery
        got |= {(r["record_key"], str(d), r["change"]) for r in store.add(df.filter(df["snap"] == d), str(d), rows_per_range=5).collect()}
    assert got == want and len(store._state()["bounds"]) >= 3
    assert {tuple(r) for r in store.between(str(days[0]), str(days[1])).collect()} == {(k, c) for k, d, c in want if d == str(days[1])}
    with pytest.raises(ValueError, match="already"):
        store.add(df, str(days[0]))


def test_runs_of_bits():
    r = np.random.default_rng(0)
    pairs = [(p, x) for p in range(20) for x in np.flatnonzero(r.random(300) < r.choice([0.05, 0.5, 0.98]))] + [(30, x) for x in range(200)]
    want = []
    for p, x in pairs:
        if want and want[-1][0] == p and want[-1][2] == x - 1:
            want[-1][2] = x
        else:
            want.append([p, x, x])
    by = r.permutation(len(pairs))
    pair, pos = (np.array(c)[by] for c in zip(*pairs))
    assert [list(map(int, x)) for x in zip(*runs(pair, pos))] == [list(map(int, x)) for x in want]


def test_empty_tables_and_single_snapshots(spark):
    none = spark.createDataFrame([], SNAP)
    assert snapshot_changes(none, ["k1"], "snap", ["a"]).count() == 0
    assert snapshot_history(none, ["k1"], "snap", ["a"]).count() == 0
    assert update_history(spark.createDataFrame([], UPDATES), ["acct"], "at", ["amt"], "row_id").count() == 0
    one = spark.createDataFrame([(DAYS[0], "x", "y", None, None, None, "", "")] * 2, SNAP)
    assert snapshot_changes(one, ["k1"], "snap", ["a"]).count() == 0
    assert [tuple(r) for r in snapshot_history(one, ["k1"], "snap", ["a", "b"]).collect()] == [("X", DAYS[0], None)]


def test_nulls_in_different_columns_differ(spark):
    rows = [(DAYS[0], "x", "y", None, None, None, "", ""), (DAYS[1], "x", "y", "-", None, None, "", "")]
    assert snapshot_changes(spark.createDataFrame(rows, SNAP), ["k1"], "snap", ["a", "b"]).collect()[0]["change"] == "changed"
