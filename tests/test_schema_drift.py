import datetime as dt
import json

import pytest
from weirflow.operators.schema_drift import drift_changes, file_types, path_values, typed_table

FEED = "rec_id long, feed string, file_no int, payload string, fields string"


def frame(spark, files):
    rows, n = [], 0
    for feed, no, payloads in files:
        for p in payloads:
            n += 1
            rows.append((n, feed, no, p if p is None or isinstance(p, str) else json.dumps(p), "clash"))
    return spark.createDataFrame(rows, FEED)


def changes(spark, files):
    df = path_values(frame(spark, files), "payload", {"feed": "feed", "file_no": "file_no"})
    return {tuple(r) for r in drift_changes(df, "order_id").collect()}


def test_added_removed_renamed_retyped(spark):
    files = [
        ("f", 1, [{"order_id": "1", "qty": 1, "who": "a", "gone": 1, "when": "2026-01-01"}, {"order_id": "2", "qty": 2, "who": "b", "gone": 2, "when": None}]),
        ("f", 2, [{"order_id": "1", "qty": "1", "buyer": "a", "new": None, "when": None}, {"order_id": "3", "qty": "2", "buyer": "z", "new": None, "when": None}]),
        ("f", 3, [{"order_id": "3", "QTY": 1.0, "buyer": "z", "new": 1, "when": "2026-01-01T00:00:00"}]),
        ("f", 5, [{"order_id": "3", "other": 1}]),
        ("g", 2, [{"order_id": "1"}]),
    ]
    assert changes(spark, files) == {
        ("f", 2, "renamed", "buyer", "who"),
        ("f", 2, "removed", "gone", ""),
        ("f", 2, "added", "new", ""),
        ("f", 2, "retyped", "qty", ""),
        ("f", 3, "added", "QTY", ""),
        ("f", 3, "removed", "qty", ""),
        ("f", 3, "retyped", "when", ""),
    }


def test_renamed_and_retyped(spark):
    files = [("f", 1, [{"order_id": "1", "n": 5}, {"order_id": "1", "n": 5}]), ("f", 2, [{"order_id": "1", "m": "5"}])]
    assert changes(spark, files) == {("f", 2, "renamed", "m", "n"), ("f", 2, "retyped", "m", "")}
    files = [("f", 1, [{"order_id": "1", "n": 5}]), ("f", 2, [{"order_id": "1", "m": 5.0}])]
    assert changes(spark, files) == {("f", 2, "added", "m", ""), ("f", 2, "removed", "n", "")}
    files = [("f", 1, [{"order_id": None, "n": 5}]), ("f", 2, [{"order_id": None, "m": 5}])]
    assert changes(spark, files) == {("f", 2, "added", "m", ""), ("f", 2, "removed", "n", "")}


def test_types(spark):
    p = {"a": 1, "b": 1.0, "c": True, "d": {"x": 1}, "e": "2026-01-01", "f": "2026-01-01T10:00:00", "g": "x", "h": None, "i": [1], "j": 12345678901234567890123}
    df = file_types(path_values(frame(spark, [("f", 1, [p, {"a": 2.5}])]), "payload", {"feed": "feed", "file_no": "file_no"}))
    got = {r["field"]: r["type"] for r in df.collect()}
    assert got == {"a": "decimal", "b": "decimal", "c": "boolean", "d": "object", "e": "date", "f": "datetime", "g": "text", "h": None, "i": "array", "j": "whole"}


FILES = [
    ("f", 1, [{"order_id": "1", "qty": 1, "who": "a"}, {"order_id": "2", "qty": 3, "who": "b"}]),
    ("f", 2, [{"order_id": "1", "qty": "x", "buyer": "a", "day": "2026-01-01"}, "broken {", None, '{"a": 1, "a": 2}', "[1]"]),
]


def test_typed_table_reports_what_does_not_cast(spark):
    df = typed_table(frame(spark, FILES), "payload", "rec_id", "feed", "file_no", "order_id")
    got = {r["rec_id"]: r.asDict() for r in df.collect()}
    assert set(df.columns) == {"rec_id", "feed", "file_no", "order_id", "qty", "who", "day", "failed", "rest"}
    assert got[1]["qty"] == 1 and got[1]["failed"] == [] and got[3]["who"] == "a" and got[3]["day"] == dt.date(2026, 1, 1)
    assert got[3]["qty"] is None and got[3]["failed"] == ["qty"]
    assert got[3]["rest"] == {"qty": "x"} and got[1]["rest"] == {}
    assert all(got[k]["failed"] == ["*"] for k in (4, 5, 6, 7))


def test_renames_of_one_feed_say_nothing_about_another(spark):
    files = [("a", 1, [{"order_id": "1", "amt": 5}]), ("a", 2, [{"order_id": "1", "amount": 5}]), ("b", 1, [{"order_id": "1", "amt": 7, "amount": 8}, {"order_id": "2", "amt": 9, "amount": 1}])]
    got = typed_table(frame(spark, files), "payload", "rec_id", "feed", "file_no", "order_id").collect()
    assert [(r["amount"], r["amt"], r["failed"]) for r in sorted(got, key=lambda r: r["rec_id"])] == [(5, None, []), (5, None, []), (8, 7, []), (1, 9, [])]


def test_two_names_of_one_column_in_a_record(spark):
    """The column's own name goes first; what it displaces is kept as text, and equal texts displace nothing."""
    files = [("a", 1, [{"order_id": "1", "amt": 5}]), ("a", 2, [{"order_id": "1", "amount": 5}]), ("a", 3, [{"order_id": "2", "amount": 6, "amt": 7}, {"order_id": "3", "amount": 6, "amt": 6}, {"order_id": "4", "amount": None, "amt": 8}, {"order_id": "5", "amount": 4}])]
    got = typed_table(frame(spark, files), "payload", "rec_id", "feed", "file_no", "order_id").collect()
    assert [(r["amount"], r["failed"], r["rest"]) for r in sorted(got, key=lambda r: r["rec_id"])] == [(5, [], {}), (5, [], {}), (6, ["amt"], {"amt": "7"}), (6, [], {}), (8, [], {}), (4, [], {})]


def test_fields_of_objects_in_records(spark):
    files = [("f", 1, [{"order_id": "1", "a": {"b": 1, "d": {"e": True}}, "x.y": 5}]), ("f", 2, [{"order_id": "1", "a": {"b": "t", "c": None, "d": {}}, "x.y": 5}, "no object"])]
    keep = {"feed": "feed", "file_no": "file_no"}
    got = lambda depth: {tuple(r) for r in drift_changes(path_values(frame(spark, files), "payload", keep, depth), "order_id").collect()}
    assert got(1) == set()
    assert got(2) == {("f", 2, "retyped", "a.b", ""), ("f", 2, "added", "a.c", "")}
    assert got(3) == got(2) | {("f", 2, "removed", "a.d.e", "")}
    assert {k for r in path_values(frame(spark, files), "payload", keep, 3).collect() for k in r["fields"] or {}} == {"order_id", "a", "a.b", "a.c", "a.d", "a.d.e", "x\\.y"}


def test_names_that_clash(spark, tmp_path):
    files = [("f", 1, [{"order_id": "1", "feed": "x", "Qty": 1, "failed": 2}]), ("f", 2, [{"order_id": "2", "qty": 5, "rec_id": 3}])]
    df = typed_table(frame(spark, files), "payload", "rec_id", "feed", "file_no", "order_id")
    df.write.parquet(str(tmp_path / "t"))
    got = {r["rec_id"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert set(got[1]) == {"rec_id", "feed", "file_no", "order_id", "feed_", "failed_", "Qty", "qty_", "rec_id_", "failed", "rest"}
    assert (got[1]["feed"], got[1]["feed_"], got[1]["Qty"], got[2]["qty_"], got[2]["rec_id_"]) == ("f", "x", 1, 5, 3)


def test_policies(spark):
    df = frame(spark, FILES)
    assert "day" not in typed_table(df, "payload", "rec_id", "feed", "file_no", "order_id", "ignore").columns
    with pytest.raises(ValueError, match="changed"):
        typed_table(df, "payload", "rec_id", "feed", "file_no", "order_id", "fail")


def test_rows_without_feed_or_number(spark):
    files = [(None, 1, [{"order_id": "1", "a": 1}]), (None, 2, [{"order_id": "1", "b": 1}]), ("f", None, [{"order_id": "1", "c": 1}]), ("f", 1, [{"order_id": "1", "a": 1}])]
    assert changes(spark, files) == set()
    got = typed_table(frame(spark, files), "payload", "rec_id", "feed", "file_no", "order_id").collect()
    assert sorted(((r["a"], r["b"], r["c"], r["failed"]) for r in got), key=repr) == sorted([(1, None, None, []), (None, 1, None, []), (None, None, 1, []), (1, None, None, [])], key=repr)


def test_empty(spark):
    assert changes(spark, []) == set()
    assert typed_table(frame(spark, []), "payload", "rec_id", "feed", "file_no", "order_id").count() == 0
