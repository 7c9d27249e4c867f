"""Validation rules. All rules that count violating rows are answered by one aggregate over the frame.

A rule gives either a violation predicate, folded with all others into a single pass, or a plan of its own (uniqueness
needs a shuffle). Failing rows are fetched only where a count says there are some.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.text_form import spark_pattern, text_of
from weirflow.plans.projection import Declared, coerced
from weirflow.plans.safe_eval import Interpreter
from weirflow.plans.terms import Scope, Term, column_of
from weirflow.registry import checks, rules

SHOWN = 5


@dataclass
class Result:
    rule: str
    passed: bool
    severity: str = "ERROR"
    column: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)
    failing: DataFrame | None = None

    @property
    def name(self) -> str:
        return f"{self.column}_{self.rule}" if self.column else self.rule

    @property
    def blocking(self) -> bool:
        return self.severity == "ERROR" and not self.passed


@dataclass
class Check:
    """A rule on a frame or one of its columns."""

    rule: str
    column: str | None = None
    severity: str = "ERROR"
    arguments: dict[str, Any] = field(default_factory=dict)


@dataclass
class Counted:
    """A rule as counts: aggregates by name, and what they mean. failing: predicate of violating rows."""

    aggregates: dict[str, Column]
    judge: Callable[[dict[str, Any]], tuple[bool, dict[str, Any]]]
    failing: Column | None = None


def violations(predicate: Column, **metadata: Any) -> Counted:
    bad = F.coalesce(predicate, F.lit(False))
    return Counted({"n": F.count_if(bad)}, lambda r: (r["n"] == 0, {"violations": r["n"], **metadata}), bad)


def _need(c: Check, name: str) -> Any:
    if c.arguments.get(name) is None:
        raise ValueError(f"{c.rule} needs '{name}'")
    return c.arguments[name]


def _text(df: DataFrame, name: str) -> Column:
    return text_of(F.col(f"`{name}`"), df.schema[name].dataType)


@rules.register("expect_column_type")
def column_type(df: DataFrame, c: Check) -> Counted:
    want = c.arguments.get("dtype") or c.arguments.get("type")
    kind = df.schema[c.column].dataType
    col = F.col(f"`{c.column}`")
    info = {"expected": want, "actual": kind.simpleString()}
    simple = {"int": T.IntegralType, "float": (T.DoubleType, T.FloatType), "string": T.StringType, "bool": T.BooleanType, "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType)}
    if want in simple:
        return Counted({}, lambda _: (isinstance(kind, simple[want]), info))
    if want not in ("date", "time"):
        raise ValueError(f"unsupported dtype '{want}'")
    if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Counted({}, lambda _: (False, info))
    late = F.count_if(col.cast("timestamp") != F.date_trunc("day", col.cast("timestamp")))
    if want == "date":
        return Counted({"late": late, "held": F.count(col)}, lambda r: (r["held"] > 0 and r["late"] == 0, info))
    return Counted({"late": late}, lambda r: (r["late"] > 0, info))


@rules.register("expect_column_values_to_not_be_null")
def not_null(df: DataFrame, c: Check) -> Counted:
    bad = F.col(f"`{c.column}`").isNull()
    return Counted({"n": F.count_if(bad)}, lambda r: (r["n"] == 0, {"null_count": r["n"]}), bad)


def _repeats(df: DataFrame, columns: list[str]) -> tuple[int, DataFrame]:
    """How many rows repeat an earlier one (nulls are equal), and such rows: counted per group, with partial aggregation."""
    keys = [F.col(f"`{x}`") for x in columns]
    groups = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_wf_more")).filter("_wf_more > 0")
    n = groups.agg(F.sum("_wf_more")).first()[0] or 0
    return n, groups.drop("_wf_more")


@rules.register("expect_column_values_to_be_unique")
def unique(df: DataFrame, c: Check) -> Result:
    n, again = _repeats(df, [c.column])
    return Result(c.rule, n == 0, c.severity, c.column, {"duplicate_count": n}, again.limit(SHOWN) if n else None)


@rules.register("expect_column_values_to_be_between")
def between(df: DataFrame, c: Check) -> Counted:
    low, high = c.arguments.get("min"), c.arguments.get("max")
    if low is None and high is None:
        raise ValueError(f"{c.rule} needs 'min' or 'max'")
    col = F.col(f"`{c.column}`")
    bad = F.lit(False)
    if low is not None:
        bad = bad | (col < F.lit(low))
    if high is not None:
        bad = bad | (col > F.lit(high))
    return violations(bad, min=low, max=high)


@rules.register("expect_column_values_to_be_in_set")
def in_set(df: DataFrame, c: Check) -> Counted:
    """Compared as texts; null has a text too, which a set rarely holds."""
    allowed = [str(x) for x in _need(c, "allowed")]
    return violations(~_text(df, c.column).isin(allowed), allowed=allowed)


@rules.register("expect_column_values_to_have_decimal_places")
def decimal_places(df: DataFrame, c: Check) -> Counted:
    most = _need(c, "max_decimal_places")
    text = _text(df, c.column)
    parts = F.split(F.trim(text), "[eE]")
    digits = F.length(F.coalesce(F.try_element_at(F.split(parts[0], r"\."), F.lit(2)), F.lit("")))
    power = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0))
    number = text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")
    return violations(F.col(f"`{c.column}`").isNotNull() & number & (F.greatest(digits - power, F.lit(0)) > most), max_decimal_places=most)


@rules.register("expect_column_value_length_equal_to")
def length_equal(df: DataFrame, c: Check) -> Counted:
    n = _need(c, "length")
    return violations(F.col(f"`{c.column}`").isNotNull() & (F.length(_text(df, c.column)) != n), length=n)


@rules.register("expect_column_value_length_between")
def length_between(df: DataFrame, c: Check) -> Counted:
    low, high = c.arguments.get("min"), c.arguments.get("max")
    if low is None and high is None:
        raise ValueError(f"{c.rule} needs 'min' or 'max'")
    n = F.length(_text(df, c.column))
    out = F.lit(False) if low is None else n < low
    return violations(F.col(f"`{c.column}`").isNotNull() & (out if high is None else out | (n > high)), min=low, max=high)


@rules.register("expect_column_value_pattern_match")
def pattern_match(df: DataFrame, c: Check) -> Counted:
    """The pattern must match from the start of the text, not to its end."""
    pattern = _need(c, "pattern")
    return violations(F.col(f"`{c.column}`").isNotNull() & ~_text(df, c.column).rlike(f"^(?:{pattern})"), pattern=pattern)


@rules.register("expect_column_datetime_value_format")
def datetime_format(df: DataFrame, c: Check) -> Counted:
    fmt = _need(c, "format")
    col = F.col(f"`{c.column}`")
    return violations(col.isNotNull() & F.try_to_timestamp(_text(df, c.column), F.lit(spark_pattern(fmt))).isNull(), format=fmt)


class _Query(Interpreter):
    """Row conditions: names are columns, `and`, `or`, `not`, `in` and chained comparisons work on them."""

    def __init__(self, df: DataFrame) -> None:
        scope = Scope(df)
        super().__init__({n: scope.field(n) for n in df.columns} | {"True": True, "False": False, "None": None}, {Term: {"is_in", "is_null", "is_not_null", "isnull", "notnull", "between", "contains", "starts_with", "ends_with"}})


def condition(df: DataFrame, text: str) -> Column:
    """A row condition; names in backquotes may hold any character."""
    odd = {n: f"_wf_c{i}" for i, n in enumerate(df.columns) if not n.isidentifier()}
    query = _Query(df)
    for n, alias in odd.items():
        text = text.replace(f"`{n}`", alias)
        query.names[alias] = Scope(df).field(n)
    return column_of(query.run(text.replace("`", "")))


@rules.register("expect_row_condition_to_be_true")
def row_condition(df: DataFrame, c: Check) -> Counted:
    """The expression describes the rows that fail: the rule passes if there are none."""
    text = _need(c, "expression")
    return violations(condition(df, text), expression=text)


@rules.register("expect_row_if_then_condition")
def if_then(df: DataFrame, c: Check) -> Counted:
    a, b = c.arguments.get("if_condition", c.arguments.get("if")), c.arguments.get("then_condition", c.arguments.get("then"))
    if not a or not b:
        raise ValueError(f"{c.rule} needs 'if' and 'then'")
    return violations(F.coalesce(condition(df, a), F.lit(False)) & ~F.coalesce(condition(df, b), F.lit(False)))


@rules.register("expect_table_row_count_to_be_between")
def row_count(df: DataFrame, c: Check) -> Counted:
    low, high = c.arguments.get("min"), c.arguments.get("max")
    return Counted({"n": F.count(F.lit(1))}, lambda r: ((low is None or r["n"] >= low) and (high is None or r["n"] <= high), {"row_count": r["n"], "min": low, "max": high}))


@rules.register("expect_table_rows_to_be_unique")
def rows_unique(df: DataFrame, c: Check) -> Result:
    n, again = _repeats(df, df.columns)
    return Result(c.rule, n == 0, c.severity, None, {"duplicate_count": n}, again.limit(SHOWN) if n else None)


@rules.register("expect_table_column_count_to_equal")
def column_count(df: DataFrame, c: Check) -> Result:
    want = _need(c, "expected")
    return Result(c.rule, len(df.columns) == want, c.severity, None, {"expected": want, "actual": len(df.columns)})


@rules.register("expect_plugin_validation")
def plugin(df: DataFrame, c: Check) -> Result:
    try:
        passed, payload = checks.get(_need(c, "plugin"))(df, **(c.arguments.get("args") or {}))
        return Result(c.rule, bool(passed), c.severity, None, payload if isinstance(payload, dict) else {"message": payload})
    except Exception as e:  # noqa: BLE001 - a failing plugin is a failed check
        return Result(c.rule, False, "ERROR", None, {"exception": str(e)})


@checks.register("validate_custom_threshold")
def custom_threshold(df: DataFrame, column: str, threshold: float) -> tuple[bool, dict[str, Any]]:
    n = df.filter(F.col(column) > threshold).count()
    return n == 0, {"violations": n, "threshold": threshold}


def implied(declared: list[Declared]) -> list[Check]:
    """The checks that a column's declaration implies."""
    out = []
    for d in declared:
        if d.dtype:
            out.append(Check("expect_column_type", d.name, arguments={"dtype": {"integer": "int", "double": "float", "text": "string", "boolean": "bool", "timestamp": "datetime"}.get(d.dtype, d.dtype)}))
        if not d.nullable:
            out.append(Check("expect_column_values_to_not_be_null", d.name))
        if d.unique:
            out.append(Check("expect_column_values_to_be_unique", d.name))
    return [c for c in out if c.arguments.get("dtype") != "timedelta"]


def validate(df: DataFrame, wanted: list[Check], declared: list[Declared] | None = None) -> list[Result]:
    """Results in the order of the checks; of checks with one name the last counts. Columns are coerced as declared first."""
    if declared:
        kinds = {d.name: d.dtype for d in declared if d.dtype}
        df = df.select(*[(coerced(F.col(f"`{f.name}`"), f.dataType, kinds[f.name]) if f.name in kinds else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])
    by_name = {f"{c.column}/{c.rule}": c for c in wanted}
    out: dict[str, Result] = {}
    counted: dict[str, tuple[Check, Counted]] = {}
    for name, c in by_name.items():
        made = rules.get(c.rule)(df, c)
        if isinstance(made, Result):
            out[name] = made
        else:
            counted[name] = (c, made)
    columns = {f"{i}/{a}": agg for i, (_, made) in enumerate(counted.values()) for a, agg in made.aggregates.items()}
    row = df.agg(*[agg.alias(n) for n, agg in columns.items()]).first().asDict() if columns else {}
    for i, (name, (c, made)) in enumerate(counted.items()):
        passed, metadata = made.judge({a: row[f"{i}/{a}"] for a in made.aggregates})
        failing = df.filter(made.failing).limit(SHOWN) if made.failing is not None and not passed else None
        out[name] = Result(c.rule, passed, c.severity, c.column, metadata, failing)
    return [out[n] for n in by_name]
