"""Projections: declared columns with their expressions, coerced to their types, with lineage."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions import columns as _functions  # noqa: F401 - registers the language
from weirflow.functions.columns import SortKey, bound, parsed
from weirflow.plans.frame import asc, desc, transform
from weirflow.plans.safe_eval import Interpreter
from weirflow.plans.terms import Scope, Term, column_of, refs_of
from weirflow.registry import column_functions

#: Declared types and those of Spark (fixed values).
TYPES = {
    "int": T.LongType(), "integer": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "string": T.StringType(), "text": T.StringType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "timestamp": T.TimestampType(), "timedelta": T.DayTimeIntervalType(),
}


@dataclass(frozen=True)
class Declared:
    """A declared column."""

    name: str
    dtype: str | None = None
    expr: str | None = None
    nullable: bool = True
    unique: bool = False
    key: bool = False

    def __post_init__(self) -> None:
        if self.dtype and self.dtype not in TYPES:
            raise ValueError(f"column '{self.name}': unknown dtype '{self.dtype}'; known: {', '.join(TYPES)}")


@dataclass
class Run:
    """What a run is called, for expressions and logs."""

    run_id: str = ""
    tags: dict[str, str] = field(default_factory=dict)
    asset_key: str = ""
    partition_key: str | None = None
    at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @property
    def run(self) -> Run:
        return self


class _Moment(Term):
    """A point in time of the language; .date() gives its day."""

    def date(self) -> Term:
        return Term(F.to_date(self.column), self.refs, self.scope)


class _Timestamp:
    def __init__(self, scope: Scope) -> None:
        self._scope = scope

    def utcnow(self) -> Term:
        return _Moment(F.current_timestamp(), frozenset(), self._scope)

    now = utcnow

    def __call__(self, text: str) -> Term:
        return _Moment(F.lit(text).try_cast("timestamp"), frozenset(), self._scope)


class _Pd:
    """The few pandas names that expressions may use, as columns."""

    def __init__(self, scope: Scope) -> None:
        self._scope = scope
        self.Timestamp = _Timestamp(scope)
        self.NaT = None

    def _term(self, c: Column, *args: Any) -> Term:
        return Term(c, refs_of(args), self._scope)

    def to_datetime(self, x: Any, format: str | None = None, errors: str = "coerce", utc: bool = False) -> Term:  # noqa: A002
        return _Moment(parsed(self._scope, x, format), refs_of([x]), self._scope)

    def to_numeric(self, x: Any, errors: str = "coerce") -> Term:
        return self._term(F.trim(column_of(x).cast("string")).try_cast("double"), x)

    def to_timedelta(self, x: Any, unit: str = "days") -> Term:
        seconds = {"days": 86400, "D": 86400, "hours": 3600, "h": 3600, "minutes": 60, "m": 60, "seconds": 1, "s": 1}[unit]
        return self._term(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (column_of(x) * seconds).cast("decimal(18,6)")), x)

    def isna(self, x: Any) -> Term:
        return self._term(column_of(x).isNull(), x)

    isnull = isna


_METHODS = {
    _Pd: {"Timestamp", "to_datetime", "to_numeric", "to_timedelta", "isna", "isnull", "NaT"},
    _Timestamp: {"utcnow", "now"},
    _Moment: {"date"},
    Run: {"run", "run_id", "tags", "asset_key", "partition_key"},
    Term: {"is_in", "is_null", "is_not_null", "between", "contains", "starts_with", "ends_with"},
    SortKey: set(),
}


def language(scope: Scope) -> dict[str, Any]:
    names: dict[str, Any] = {n: bound(n, scope) for n in column_functions}
    return names | {"pd": _Pd(scope), "context": scope.run or Run(), "asc": asc, "desc": desc, "True": True, "False": False, "None": None}


def compile_column(expression: str, scope: Scope) -> Term:
    """A column expression over the scope's frame."""
    out = Interpreter(language(scope), _METHODS).run(expression)
    return out if isinstance(out, Term) else Term(F.lit(out), frozenset(), scope)


def coerced(c: Column, have: T.DataType, dtype: str) -> Column:
    """A column as its declared type. What doesn't convert is null; a fraction declared int, or a text declared bool, is an error."""
    want = TYPES[dtype]
    if have == want:
        return c
    if isinstance(want, T.LongType):
        if isinstance(have, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint")
        d = F.trim(c.cast("string")).try_cast("double")
        return F.when(d == F.floor(d), d.cast("bigint")).when(d.isNotNull(), F.raise_error(F.concat(F.lit("no whole number: "), c.cast("string"))).cast("bigint"))
    if isinstance(want, T.DoubleType):
        return F.trim(c.cast("string")).try_cast("double") if isinstance(have, T.StringType) else c.cast("double")
    if isinstance(want, T.BooleanType):
        if isinstance(have, T.StringType):
            return F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("no boolean: "), c)).cast("boolean"))
        return c.cast("boolean")
    if isinstance(want, (T.DateType, T.TimestampType)):
        return parsed_any(c, have).cast(want)
    return c.cast(want)


def parsed_any(c: Column, have: T.DataType) -> Column:
    if isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(have, T.StringType):
        return F.trim(c).try_cast("timestamp")
    return c.cast("string").try_cast("timestamp")


@dataclass
class Projected:
    data: DataFrame
    lineage: dict[str, frozenset[str]]


def project(df: DataFrame, columns: list[Declared], pre: str | None = None, post: str | None = None, run: Run | None = None) -> Projected:
    """Pre chain, one expression per declared column over its result, post chain, coercion: a single lazy plan."""
    if pre:
        df = transform(df, pre).data
    scope = Scope(df, run)
    terms = {c.name: compile_column(c.expr or f"ref({c.name!r})", scope) for c in columns}
    out = scope.frame().select(*[t.column.alias(n) for n, t in terms.items()])
    lineage = {n: t.refs for n, t in terms.items()}
    order = None
    if post:
        frame = transform(out, post)
        out, order = frame.data, frame.order
    try:
        kinds = dict(zip(out.columns, [f.dataType for f in out.schema.fields]))
        typed = {c.name: coerced(F.col(f"`{c.name}`"), kinds[c.name], c.dtype) for c in columns if c.dtype and c.name in kinds}
    except Exception as e:
        raise ValueError(f"coercion failed: {e}") from e
    out = out.select(*[typed.get(n, F.col(f"`{n}`")).alias(n) for n in out.columns])
    if order:
        out = out.orderBy(*[k.column for k in order if k.name is None or k.name in out.columns])
    return Projected(out, lineage)
