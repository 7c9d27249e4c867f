import datetime as dt
import itertools
import random
import re
import statistics

import pytest
from weirflow.operators.expressions_mdl import facts, induce, skeletons
from weirflow.operators.load_profile import Watched, coverage, findings, induced, load_dates, medians, profile, value_counts

W = [Watched("amount", "number", 0, 1_000_000), Watched("day", "day", 0, 60), Watched("cat", "text")]
SCHEMA = "file string, amount double, day date, cat string, value string, load string, n int"
NAME = "^t_(.+)_([0-9]{4}-[0-9]{2}-[0-9]{2})[.]csv$"


def run(spark, rows):
    counts = value_counts(spark.createDataFrame(rows, SCHEMA), "file", W)
    loads = load_dates(counts, NAME)
    columns, shares = induced(counts, W)
    stats = profile(counts, loads, columns, shares)
    return columns, stats, findings(counts, loads, stats, columns)


def load(name, day, n=100, amount=lambda i: 10.0 + i, late=lambda i: 1, cat=lambda i: ["fees", "pets", "cash_out"][i % 3]):
    return [(name, amount(i), None if late(i) is None else day - dt.timedelta(days=late(i)), cat(i), "", "", 1) for i in range(n)]


def test_findings(spark):
    d = [dt.date(2026, 1, 1) + dt.timedelta(days=7 * i) for i in range(8)]
    name = lambda i: f"t_b_{d[i]}.csv"
    rows = load(name(0), d[0]) + load(name(1), d[1], amount=lambda i: -5.0 if i < 5 else 10.0 + i)
    rows += load(name(2), d[2], late=lambda i: 70 if i < 5 else 1) + load(name(3), d[3], cat=lambda i: "Bad One" if i < 5 else ["fees", "pets", "cash_out"][i % 3])
    rows += load(name(4), d[4], amount=lambda i: None if i < 13 else 10.0 + i) + load(name(5), d[5], amount=lambda i: 10.0 + i % 30)
    rows += load(name(6), d[6], amount=lambda i: 10_000.0 + i % 30) + load(name(7), d[7], amount=lambda i: 10_000.0 + i % 30, cat=lambda i: "fees")
    rows += load("no date.csv", d[0]) + load(None, d[0])
    _, stats, f = run(spark, rows)
    counts = value_counts(spark.createDataFrame(rows, SCHEMA), "file", W)
    covered = {r["load"]: (r["covered"], r["covered_before"]) for r in coverage(stats, load_dates(counts, NAME)).filter("column = 'cat'").collect()}
    assert covered[name(0)] == (1.0, None) and covered[name(3)] == (0.95, 1.0) and covered[name(4)] == (1.0, 0.95)
    assert {tuple(r) for r in f.collect()} == {
        (name(1), "amount", "range"), (name(2), "day", "range"), (name(3), "cat", "pattern"), (name(4), "amount", "null_rate"),
        (name(5), "amount", "null_rate"), (name(5), "amount", "distinct"), (name(6), "amount", "shift"), (name(7), "cat", "distinct"), (name(7), "cat", "shift"),
    }


def test_no_hint_about_values_is_needed(spark):
    """The expressions that decide come from the values alone, whatever their alphabet; one load gone astray adds nothing to them."""
    d = [dt.date(2026, 1, 1) + dt.timedelta(days=7 * i) for i in range(6)]
    codes = lambda i: f"{'ABCDE'[i % 5]}{i % 7}{i % 9}-{i % 90:03d}"
    rows = [r for i in range(5) for r in load(f"t_b_{d[i]}.csv", d[i], cat=codes)]
    rows += load(f"t_b_{d[5]}.csv", d[5], cat=lambda i: f"lost_{'xyz' * (i % 5 + 1)}" if i < 30 else codes(i))
    columns, _, f = run(spark, rows)
    cat = columns[2]
    assert any("lost_xyz" == re.fullmatch(e.pattern, "lost_xyz").group() for e in cat.expressions if re.fullmatch(e.pattern, "lost_xyz"))
    assert not any(re.fullmatch(cat.expressions[i].pattern, "lost_xyz") for i in cat.typical)
    assert {tuple(r)[:2] for r in f.filter("finding = 'pattern'").collect()} == {(f"t_b_{d[5]}.csv", "cat")}


def test_null_and_empty_load_names_are_two_loads(spark):
    rows = [("", 1.0, None, "x", "", "", 1), ("", 2.0, None, "x", "", "", 1), (None, 50.0, None, "x", "", "", 1)]
    _, stats, _ = run(spark, rows)
    assert {(r["load"], r["median"]) for r in stats.filter("column = 'amount'").collect()} == {("", 1.5), (None, 50.0)}


def test_skeletons_beyond_the_bound_are_summed_up(spark):
    values = [("c", "".join(x)) for x in itertools.product("a1-", repeat=5)] + [("d", "x")]
    shapes = skeletons(spark.createDataFrame(values, "column string, value string"))
    full, few = facts(shapes), facts(shapes, most=3)
    assert len(few) <= 3 + 3 + 2 < len(full)
    assert sum(r["n"] for r in few) == sum(r["n"] for r in full) == len(values) and sum(r["chars"] for r in few) == sum(r["chars"] for r in full)
    assert induce([r for r in few if r["column"] == "c"]) is not None


def test_null_load_keeps_its_findings(spark):
    day = dt.date(2026, 1, 1)
    rows = load("t_b_2026-01-01.csv", day) + load(None, day, amount=lambda i: -5.0 if i < 5 else 10.0 + i, cat=lambda i: "Bad One" if i < 5 else ["fees", "pets", "cash_out"][i % 3])
    counts = value_counts(spark.createDataFrame(rows, SCHEMA), "file", W)
    _, stats, f = run(spark, rows)
    assert {tuple(r) for r in f.collect()} == {(None, "amount", "range"), (None, "cat", "pattern")}
    got = coverage(stats, load_dates(counts, NAME)).filter("load IS NULL AND column = 'cat'").collect()
    assert [(r["covered"], r["covered_before"]) for r in got] == [(0.95, None)]


def test_codes_of_one_value_per_skeleton_are_covered(spark):
    codes = ["".join(x) for n in (4, 5, 6) for x in itertools.product("aA1", repeat=n) if all(a != b for a, b in itertools.pairwise(x))]
    counts = spark.createDataFrame([("l", "code", c, 1) for c in codes], "load string, column string, value string, n long")
    ((w,), _) = induced(counts, [Watched("code", "text")])
    assert w.expressions and sum(e.values for e in w.expressions) == len(codes)
    assert all(re.fullmatch("|".join(e.pattern for e in w.expressions), c) for c in codes)


def test_nulls_and_empty(spark):
    columns, stats, f = run(spark, [])
    assert stats.count() == 0 and f.count() == 0 and not any(w.expressions for w in columns)
    rows = [("t_b_2026-01-01.csv", None, None, None, "", "", 1)] * 3 + [("t_b_2026-01-02.csv", float("nan"), None, None, "", "", 1)]
    _, stats, f = run(spark, rows)
    assert all(r["nulls"] == r["n"] and r["median"] is None for r in stats.collect()) and f.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_medians_are_exact(spark, seed):
    r = random.Random(seed)
    groups = {k: [r.choice([r.uniform(-5, 5), r.uniform(-1e9, 1e9), 0.0, float(r.randint(0, 3))]) for _ in range(r.randint(1, 200))] for k in range(20)}
    df = spark.createDataFrame([(k, x, 1) for k, v in groups.items() for x in v], "g int, x double, n long")
    got = {x["g"]: x["median"] for x in medians(df, ["g"]).collect()}
    assert got == pytest.approx({k: statistics.median(v) for k, v in groups.items()})


def test_induced_expressions(spark):
    values = [("c", w) for w in "fees fuel pets books cash_out travel_fare refund gifts hobby medical payroll insurance".split()] + [("c", "Odd Value!")]
    values += [("d", f"2026-01-{i:02d}") for i in range(1, 29)]
    rows = [r.asDict() for r in skeletons(spark.createDataFrame(values, "column string, value string")).collect()]
    c = induce([r for r in rows if r["column"] == "c"])
    assert c and all(re.fullmatch("|".join(e.pattern for e in c), v) for k, v in values[:12])
    assert not re.fullmatch("|".join(e.pattern for e in c), "Odd Value!")
    d = induce([r for r in rows if r["column"] == "d"])
    assert re.fullmatch("|".join(e.pattern for e in d), "1999-12-31") and not re.fullmatch("|".join(e.pattern for e in d), "31.12.1999x")
