"""The column functions of the expression language. Each takes a scope and terms or constants, and gives a column."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.text_form import ISO_PATTERNS, spark_pattern, text_of
from weirflow.plans.terms import Scope, Term, column_of, refs_of
from weirflow.registry import column_functions


def column_function(name: str) -> Callable:
    """Register f(scope, *arguments) -> Column under a name of the language."""
    return column_functions.register(name)


def bound(name: str, scope: Scope) -> Callable[..., Any]:
    """The function as expressions call it: without the scope, giving a term that knows its fields."""
    f = column_functions.get(name)

    @functools.wraps(f)
    def call(*args: Any, **kwargs: Any) -> Any:
        out = f(scope, *args, **kwargs)
        return Term(out, refs_of([*args, *kwargs.values()]), scope) if isinstance(out, Column) else out

    return call


def _type(scope: Scope, x: Any) -> T.DataType:
    return scope.type_of(column_of(x))


def _text(scope: Scope, x: Any) -> Column:
    return text_of(column_of(x), _type(scope, x))


def _at_least_one(name: str, args: tuple) -> None:
    if not args:
        raise ValueError(f"{name} takes at least one argument")


# --- access, nulls, conditions -------------------------------------------------------------------------------------


@column_function("ref")
def ref(scope: Scope, name: str) -> Term:
    return scope.field(name)


@column_function("value")
def value(scope: Scope, x: Any) -> Any:
    return x


@column_function("coalesce")
def coalesce(scope: Scope, *args: Any) -> Column:
    _at_least_one("coalesce", args)
    return F.coalesce(*[column_of(a) for a in args])


@column_function("fill_na")
def fill_na(scope: Scope, x: Any, default: Any) -> Column:
    return F.coalesce(column_of(x), column_of(default))


@column_function("null_if")
def null_if(scope: Scope, x: Any, other: Any) -> Column:
    return F.nullif(column_of(x), column_of(other))


@column_function("is_null")
def is_null(scope: Scope, x: Any) -> Column:
    return column_of(x).isNull()


@column_function("when")
def when(scope: Scope, condition: Any, then: Any, otherwise: Any = None) -> Column:
    """A null condition takes the other branch."""
    return F.when(column_of(condition), column_of(then)).otherwise(column_of(otherwise))


@column_function("map_values")
def map_values(scope: Scope, x: Any, mapping: dict, default: Any = None) -> Column:
    """Null and what isn't in the mapping give the default."""
    if not mapping:
        return column_of(default)
    pairs = F.create_map(*[F.lit(v) for k in mapping for v in (k, mapping[k])])
    kind = scope.type_of(pairs).keyType
    return F.coalesce(F.try_element_at(pairs, column_of(x).cast(kind)), column_of(default))


# --- texts ---------------------------------------------------------------------------------------------------------


@column_function("upper")
def upper(scope: Scope, x: Any) -> Column:
    return F.upper(column_of(x))


@column_function("lower")
def lower(scope: Scope, x: Any) -> Column:
    return F.lower(column_of(x))


@column_function("trim")
def trim(scope: Scope, x: Any) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(column_of(x), r"(?U)^\s+|\s+$", "")


@column_function("concat")
def concat(scope: Scope, *args: Any) -> Column:
    _at_least_one("concat", args)
    return F.concat(*[_text(scope, a) for a in args])


@column_function("substr")
def substr(scope: Scope, x: Any, start: int, length: int) -> Column:
    """Characters start to start + length as a slice: counted from 0, or from the end if negative."""
    c = column_of(x)
    n = F.length(c)

    def bound_at(k: int) -> Column:
        return F.least(F.lit(k), n) if k >= 0 else F.greatest(n + k, F.lit(0))

    lo, hi = bound_at(start), bound_at(start + length)
    return F.substr(c, lo + 1, F.greatest(hi - lo, F.lit(0)))


@column_function("replace_str")
def replace_str(scope: Scope, x: Any, old: str, new: str) -> Column:
    return F.replace(column_of(x), F.lit(old), F.lit(new))


@column_function("split")
def split(scope: Scope, x: Any, separator: str, index: int) -> Column:
    """One part, counted from 0 or from the end; null if there are fewer. The separator is literal."""
    parts = F.split(column_of(x), rf"\Q{separator}\E")
    return F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


@column_function("to_string")
def to_string(scope: Scope, x: Any) -> Column:
    return _text(scope, x)


# --- numbers -------------------------------------------------------------------------------------------------------


@column_function("round_val")
def round_val(scope: Scope, x: Any, decimals: int = 2) -> Column:
    """Half to even after scaling."""
    scale = F.lit(10.0**decimals)
    return F.rint(column_of(x).cast("double") * scale) / scale


@column_function("abs_val")
def abs_val(scope: Scope, x: Any) -> Column:
    return F.abs(column_of(x))


@column_function("floor_val")
def floor_val(scope: Scope, x: Any) -> Column:
    return F.floor(column_of(x)).cast("double")


@column_function("ceil_val")
def ceil_val(scope: Scope, x: Any) -> Column:
    return F.ceil(column_of(x)).cast("double")


@column_function("to_numeric")
def to_numeric(scope: Scope, x: Any) -> Column:
    return F.trim(column_of(x).cast("string")).try_cast("double")


# --- dates ---------------------------------------------------------------------------------------------------------


def parsed(scope: Scope, x: Any, fmt: str | None) -> Column:
    c = column_of(x)
    kind = _type(scope, x)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    c = F.trim(c.cast("string"))
    if fmt:
        return F.try_to_timestamp(c, F.lit(spark_pattern(fmt)))
    return F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(p)) for p in ISO_PATTERNS])


@column_function("to_date")
def to_date(scope: Scope, x: Any, fmt: str | None = None) -> Column:
    return parsed(scope, x, fmt).cast("date")


@column_function("to_datetime")
def to_datetime(scope: Scope, x: Any, fmt: str | None = None) -> Column:
    return parsed(scope, x, fmt)


@column_function("now")
def now(scope: Scope) -> Column:
    return F.current_timestamp()


@column_function("today")
def today(scope: Scope) -> Column:
    return F.current_date()


_SECONDS = {"days": 86_400, "hours": 3600, "minutes": 60, "seconds": 1}
_UNIT = {"day": "days", "d": "days", "hour": "hours", "h": "hours", "minute": "minutes", "min": "minutes", "second": "seconds", "s": "seconds"}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


@column_function("date_diff")
def date_diff(scope: Scope, end: Any, start: Any, unit: str = "days") -> Column:
    """Whole days rounded down, or hours, minutes and seconds with fractions; other units count as days."""
    delta = _micros(column_of(end)) - _micros(column_of(start))
    unit = _UNIT.get(unit, unit)
    if unit in ("hours", "minutes", "seconds"):
        return delta / F.lit(_SECONDS[unit] * 1e6)
    return F.floor(delta / F.lit(86_400e6)).cast("bigint")


@column_function("date_add")
def date_add(scope: Scope, x: Any, n: Any, unit: str = "days") -> Column:
    """Exact spans only; weeks, months and years are refused."""
    unit = _UNIT.get(unit, unit)
    exact = {**_SECONDS, "milliseconds": 1e-3, "ms": 1e-3, "microseconds": 1e-6, "us": 1e-6}
    if unit not in exact:
        raise ValueError(f"date_add can't add '{unit}'")
    micros = (column_of(n).cast("double") * F.lit(exact[unit] * 1e6)).cast("bigint") if isinstance(n, float) else column_of(n).cast("bigint") * F.lit(int(exact[unit] * 1e6)).cast("bigint")
    c = column_of(x)
    kind = _type(scope, x)
    out = F.timestamp_micros(_micros(c) + micros)
    return out.cast("timestamp_ntz") if isinstance(kind, (T.TimestampNTZType, T.DateType)) else out


@column_function("date_trunc")
def date_trunc(scope: Scope, x: Any, period: str = "month") -> Column:
    if period not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"date_trunc has no period '{period}'")
    out = F.date_trunc(period, column_of(x).cast("timestamp"))
    return out if isinstance(_type(scope, x), T.TimestampType) else out.cast("timestamp_ntz")


_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter,
    "dayofweek": F.weekday, "weekday": F.weekday, "day_of_week": F.weekday, "dayofyear": F.dayofyear, "day_of_year": F.dayofyear, "week": F.weekofyear,
    "date": lambda c: c.cast("date"),
    "microsecond": lambda c: F.pmod(_micros(c), F.lit(1_000_000)),
    "days_in_month": lambda c: F.dayofmonth(F.last_day(c)),
    "is_month_end": lambda c: F.last_day(c) == c.cast("date"),
    "is_month_start": lambda c: F.dayofmonth(c) == 1,
    "is_leap_year": lambda c: F.dayofyear(F.make_date(F.year(c), F.lit(12), F.lit(31))) == 366,
}


@column_function("extract_part")
def extract_part(scope: Scope, x: Any, part: str) -> Column:
    """Monday is day 0 of the week."""
    if part not in _PARTS:
        raise ValueError(f"extract_part has no part '{part}'")
    out = _PARTS[part](column_of(x))
    return out if part in ("date",) or part.startswith("is_") else out.cast("bigint")


# --- keys ----------------------------------------------------------------------------------------------------------


@column_function("hash_key")
def hash_key(scope: Scope, *args: Any) -> Column:
    """MD5 of the texts of all arguments, joined by a bar; nulls have a text."""
    _at_least_one("hash_key", args)
    return F.md5(F.concat_ws("|", *[_text(scope, a) for a in args]))


@column_function("uuid_key")
def uuid_key(scope: Scope) -> Column:
    return F.uuid()


# --- aggregates of the whole frame: no window over everything, one subquery for all of them -------------------------


@column_function("sum_of")
def sum_of(scope: Scope, x: Any) -> Column:
    return scope.whole(F.coalesce(F.sum(column_of(x)), F.lit(0)))


@column_function("mean_of")
def mean_of(scope: Scope, x: Any) -> Column:
    return scope.whole(F.avg(column_of(x)))


@column_function("min_of")
def min_of(scope: Scope, x: Any) -> Column:
    return scope.whole(F.min(column_of(x)))


@column_function("max_of")
def max_of(scope: Scope, x: Any) -> Column:
    return scope.whole(F.max(column_of(x)))


@column_function("count_of")
def count_of(scope: Scope, x: Any) -> Column:
    return scope.whole(F.count(column_of(x)))


# --- windows -------------------------------------------------------------------------------------------------------


def _listed(x: Any) -> list[Column]:
    return [column_of(v) for v in (x if isinstance(x, (list, tuple)) else [x])]


def _sorted(x: Any) -> list[Column]:
    """Ascending, nulls last; sort keys (asc, desc) keep their direction."""
    return [v.column if isinstance(v, SortKey) else column_of(v).asc_nulls_last() for v in (x if isinstance(x, (list, tuple)) else [x])]


class SortKey:
    """A direction of the language: asc("x"), desc("x"); nulls come last either way."""

    def __init__(self, field: Any, ascending: bool = True) -> None:
        self.name = field if isinstance(field, str) else None
        c = F.col(f"`{field}`") if isinstance(field, str) else column_of(field)
        self.plain, self.ascending = c, ascending
        self.column = c.asc_nulls_last() if ascending else c.desc_nulls_last()


def _over(part: Any, order: Any):  # noqa: ANN202
    return Window.partitionBy(*_listed(part)).orderBy(*_sorted(order))


def _keyed(part: Any, out: Column) -> Column:
    """Rows without a partition key have no place in a window."""
    held = functools.reduce(lambda a, b: a & b, [c.isNotNull() for c in _listed(part)])
    return F.when(held, out)


@column_function("row_number")
def row_number(scope: Scope, part: Any, order: Any) -> Column:
    return _keyed(part, F.row_number().over(_over(part, order)).cast("bigint"))


@column_function("rank")
def rank(scope: Scope, part: Any, order: Any, method: str = "min") -> Column:
    w = _over(part, order)
    peers = Window.partitionBy(*_listed(part), *[v.plain if isinstance(v, SortKey) else column_of(v) for v in (order if isinstance(order, (list, tuple)) else [order])])
    ways = {
        "min": lambda: F.rank().over(w).cast("bigint"),
        "dense": lambda: F.dense_rank().over(w).cast("bigint"),
        "first": lambda: F.row_number().over(w).cast("bigint"),
        "max": lambda: F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "average": lambda: F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2.0,
    }
    if method not in ways:
        raise ValueError(f"rank has no method '{method}'")
    orders = [v.plain if isinstance(v, SortKey) else column_of(v) for v in (order if isinstance(order, (list, tuple)) else [order])]
    held = functools.reduce(lambda a, b: a & b, [c.isNotNull() for c in orders])
    return _keyed(part, F.when(held, ways[method]()))


@column_function("lag")
def lag(scope: Scope, x: Any, n: int, part: Any, order: Any) -> Column:
    return _keyed(part, F.lag(column_of(x), n).over(_over(part, order)))


@column_function("lead")
def lead(scope: Scope, x: Any, n: int, part: Any, order: Any) -> Column:
    return _keyed(part, F.lead(column_of(x), n).over(_over(part, order)))
