import datetime as dt

import pytest
from weirflow.operators.quality import Check, implied, validate
from weirflow.plans.projection import Declared
from weirflow.registry import checks


@pytest.fixture(scope="module")
def t(spark):
    rows = [(1, "a", 1.5, dt.datetime(2026, 1, 1), "2026-01-01"), (2, "b", 2.25, dt.datetime(2026, 1, 2), "2026-01-32"), (2, None, None, None, None), (2, None, None, None, None)]
    return spark.createDataFrame(rows, "id int, s string, x double, ts timestamp_ntz, `odd name` string")


@pytest.mark.parametrize(
    ("rule", "column", "args", "passed", "count"),
    [
        ("expect_column_values_to_not_be_null", "s", {}, False, 2),
        ("expect_column_values_to_not_be_null", "id", {}, True, 0),
        ("expect_column_values_to_be_unique", "id", {}, False, 2),
        ("expect_column_values_to_be_unique", "s", {}, False, 1),
        ("expect_column_values_to_be_between", "x", {"min": 2}, False, 1),
        ("expect_column_values_to_be_between", "x", {"min": 1, "max": 3}, True, 0),
        ("expect_column_values_to_be_in_set", "s", {"allowed": ["a", "b"]}, False, 2),
        ("expect_column_values_to_be_in_set", "id", {"allowed": ["1", 2]}, True, 0),
        ("expect_column_values_to_have_decimal_places", "x", {"max_decimal_places": 1}, False, 1),
        ("expect_column_values_to_have_decimal_places", "x", {"max_decimal_places": 2}, True, 0),
        ("expect_column_value_length_equal_to", "s", {"length": 1}, True, 0),
        ("expect_column_value_length_between", "odd name", {"min": 11}, False, 2),
        ("expect_column_value_pattern_match", "odd name", {"pattern": "20"}, True, 0),
        ("expect_column_value_pattern_match", "odd name", {"pattern": "01|x"}, False, 2),
        ("expect_column_datetime_value_format", "odd name", {"format": "%Y-%m-%d"}, False, 1),
        ("expect_row_condition_to_be_true", None, {"expression": "id > 1 and s == 'b'"}, False, 1),
        ("expect_row_condition_to_be_true", None, {"expression": "id not in [1, 2]"}, True, 0),
        ("expect_row_condition_to_be_true", None, {"expression": "`odd name` == '2026-01-01' or 1 < x < 2"}, False, 1),
        ("expect_row_if_then_condition", None, {"if": "id == 2", "then": "x > 2"}, False, 2),
        ("expect_table_row_count_to_be_between", None, {"min": 1, "max": 3}, False, None),
        ("expect_table_rows_to_be_unique", None, {}, False, 1),
        ("expect_table_column_count_to_equal", None, {"expected": 5}, True, None),
        ("expect_plugin_validation", None, {"plugin": "validate_custom_threshold", "args": {"column": "x", "threshold": 2}}, False, 1),
        ("expect_plugin_validation", None, {"plugin": "unknown"}, False, None),
        ("expect_column_type", "id", {"dtype": "int"}, True, None),
        ("expect_column_type", "id", {"dtype": "float"}, False, None),
        ("expect_column_type", "ts", {"dtype": "date"}, True, None),
        ("expect_column_type", "ts", {"dtype": "time"}, False, None),
        ("expect_column_type", "s", {"dtype": "date"}, False, None),
    ],
)
def test_rules(t, rule, column, args, passed, count):
    r = validate(t, [Check(rule, column, arguments=args)])[0]
    assert r.passed is passed
    if count is not None:
        assert next(r.metadata[k] for k in ("violations", "null_count", "duplicate_count") if k in r.metadata) == count
    if r.failing is not None:
        assert 0 < r.failing.count() <= 5


@pytest.mark.parametrize(("rule", "args"), [("expect_column_values_to_be_between", {}), ("expect_column_value_length_between", {}), ("expect_column_value_length_equal_to", {}), ("expect_column_type", {"dtype": "blob"}), ("expect_nothing", {})])
def test_bad_rules(t, rule, args):
    with pytest.raises(ValueError):
        validate(t, [Check(rule, "s", arguments=args)])


def test_one_pass_and_names(t):
    wanted = [Check("expect_column_values_to_not_be_null", "s", "WARN"), Check("expect_column_values_to_be_between", "id", arguments={"min": 5}), Check("expect_column_values_to_be_between", "id", arguments={"min": 1})]
    got = validate(t, wanted)
    assert [(r.name, r.passed, r.blocking) for r in got] == [("s_expect_column_values_to_not_be_null", False, False), ("id_expect_column_values_to_be_between", True, False)]


def test_implied_and_empty(t):
    d = [Declared("id", "int", nullable=False, unique=True), Declared("ts", "date"), Declared("s", "string")]
    got = {r.name: r.passed for r in validate(t, implied(d), d)}
    assert got["id_expect_column_values_to_be_unique"] is False and got["id_expect_column_type"] and got["ts_expect_column_type"] and got["id_expect_column_values_to_not_be_null"]
    assert all(r.passed for r in validate(t.limit(0), [Check("expect_column_values_to_be_unique", "id"), Check("expect_column_values_to_not_be_null", "s"), Check("expect_table_rows_to_be_unique")]))


def test_plugins(t):
    checks.register("two_rows_at_least")(lambda df: (df.count() >= 2, "counted"))
    r = validate(t, [Check("expect_plugin_validation", arguments={"plugin": "two_rows_at_least"})])[0]
    checks.remove("two_rows_at_least")
    assert r.passed and r.metadata == {"message": "counted"}
