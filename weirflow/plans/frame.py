"""Frames: data frames that remember their row order, with the table-level operations of the language.

Spark frames have no order, the language's operations do (which row of a key is first, what a limit cuts). A frame carries its sort
keys; where none were given, order-dependent operations use the order in which rows were read.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.functions.columns import SortKey
from weirflow.plans.safe_eval import Interpreter, Refused
from weirflow.plans.terms import Scope, Term, col, column_of

_ORD = "_wf_order"


class Aggregate:
    """An aggregate of one field: agg_sum("x").alias("total")."""

    def __init__(self, how: str, field: str, name: str | None = None) -> None:
        self.how, self.field, self.name = how, field, name or f"{how}_{field}"

    def alias(self, name: str) -> Aggregate:
        return Aggregate(self.how, self.field, name)


def asc(field: Any) -> SortKey:
    return SortKey(field, True)


def desc(field: Any) -> SortKey:
    return SortKey(field, False)


def _maker(how: str):  # noqa: ANN202
    return lambda field: Aggregate(how, field)


AGGREGATES = {f"agg_{how}": _maker(how) for how in ("sum", "count", "mean", "min", "max", "first", "last")}
agg_sum, agg_count, agg_mean, agg_min, agg_max, agg_first, agg_last = (AGGREGATES[f"agg_{h}"] for h in ("sum", "count", "mean", "min", "max", "first", "last"))


class Frame:
    def __init__(self, df: DataFrame, order: list[SortKey] | None = None) -> None:
        self.data, self.order = df, order

    @property
    def columns(self) -> list[str]:
        return self.data.columns

    def df(self) -> DataFrame:
        """The data, sorted if an order was asked for."""
        return self.data.orderBy(*[k.column for k in self.order]) if self.order else self.data

    def _need(self, *names: str) -> None:
        missing = [n for n in names if n not in self.data.columns]
        if missing:
            raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(self.data.columns)}")

    def _with(self, df: DataFrame) -> Frame:
        kept = [k for k in self.order or [] if k.name is None or k.name in df.columns]
        return Frame(df, kept or None)

    # --- rows and columns

    def filter(self, condition: Term | Column) -> Frame:
        if isinstance(condition, Term):
            self._need(*condition.refs)
        return self._with(self.data.filter(column_of(condition)))

    def select(self, *names: str) -> Frame:
        self._need(*names)
        return self._with(self.data.select(*[f"`{n}`" for n in names]))

    def drop(self, *names: str) -> Frame:
        self._need(*names)
        return self._with(self.data.drop(*names))

    def rename(self, names: dict[str, str]) -> Frame:
        order = [SortKey(names.get(k.name, k.name), k.ascending) if k.name else k for k in self.order or []]
        return Frame(self.data.withColumnsRenamed({a: b for a, b in names.items() if a in self.data.columns}), order or None)

    # --- order

    def order_by(self, *keys: Any) -> Frame:
        flat = [x for k in keys for x in (k if isinstance(k, (list, tuple)) else [k])]
        sort = [k if isinstance(k, SortKey) else asc(k) for k in flat]
        self._need(*[k.name for k in sort if k.name])
        return Frame(self.data, sort)

    def limit(self, n: int) -> Frame:
        return Frame(self.df().limit(n), self.order)

    def _ordered(self) -> tuple[DataFrame, list[Column]]:
        """The data with a tie-breaker, and what sorts it."""
        df = self.data.withColumn(_ORD, F.monotonically_increasing_id())
        return df, [*[k.column for k in self.order or []], F.col(_ORD).asc()]

    def dedup(self, names: list[str] | str, keep: str | bool = "first") -> Frame:
        """One row per key: the first or last in order; with keep=False only rows whose key comes once. Nulls are equal.

        ``row_number() = 1`` is cut down to a row per key and task before the shuffle, so hot keys don't gather.
        """
        names = [names] if isinstance(names, str) else list(names)
        self._need(*names)
        keys = [F.col(f"`{n}`") for n in names]
        if keep is False:
            packed = self.data.select(*keys, F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("_wf_row"))
            once = packed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_wf_n"), F.any_value("_wf_row").alias("_wf_row")).filter("_wf_n = 1")
            return self._with(once.select("_wf_row.*"))
        if keep not in ("first", "last"):
            raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
        df, sort = self._ordered()
        if keep == "last":
            sort = [*[(k.plain.desc_nulls_first() if k.ascending else k.plain.asc_nulls_first()) for k in self.order or []], F.col(_ORD).desc()]
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
        return self._with(df.withColumn("_wf_n", n).filter("_wf_n = 1").drop("_wf_n", _ORD))

    def distinct(self, names: list[str] | None = None) -> Frame:
        return self._with(self.data.distinct()) if names is None else self.dedup(names)

    # --- groups

    def group_by(self, names: list[str] | str) -> Grouped:
        names = [names] if isinstance(names, str) else list(names)
        self._need(*names)
        return Grouped(self, names)

    def rollup(self, names: list[str] | str) -> Grouped:
        """Groups by the keys, by each shorter list of the first ones, and over all; null keys of the result mark totals."""
        return self._several(names, "rollup")

    def cube(self, names: list[str] | str) -> Grouped:
        """Groups by every subset of the keys; null keys of the result mark totals."""
        return self._several(names, "cube")

    def _several(self, names: list[str] | str, kind: str) -> Grouped:
        names = [names] if isinstance(names, str) else list(names)
        self._need(*names)
        return Grouped(self, names, kind)

    # --- several frames (extensions)

    def join(self, other: Frame | DataFrame, on: Any, how: str = "inner") -> Frame:
        right = other.data if isinstance(other, Frame) else other
        return self._with(self.data.join(right, column_of(on) if isinstance(on, (Term, Column)) else on, how))

    def join_asof(self, other: Frame | DataFrame, by: list[str] | str, at: str, take: list[str], bucket_seconds: int | None = None) -> Frame:
        """Every row with the columns ``take`` of the last row of ``other`` of the same key that isn't later; null where there is none.

        Both sides are sorted together once per key, without a join. bucket_seconds: cut each key's time into buckets of this length, so
        a hot key is spread; only the last row of each bucket is then carried into the buckets behind. Rows with a null key or time match nothing.
        """
        right = other.data if isinstance(other, Frame) else other
        by = [by] if isinstance(by, str) else list(by)
        self._need(*by, at)
        keys = [F.col(f"`{k}`") for k in by]
        row = lambda names: F.struct(*[F.col(f"`{n}`") for n in names])
        mine = self.data.select(*keys, F.col(f"`{at}`").alias("_wf_at"), row(self.columns).alias("_wf_l"), F.lit(None).cast(right.select(*take).schema).alias("_wf_r"))
        theirs = right.select(*keys, F.col(f"`{at}`").alias("_wf_at"), F.lit(None).cast(self.data.schema).alias("_wf_l"), row(take).alias("_wf_r"))
        both = mine.unionByName(theirs.filter(F.col("_wf_at").isNotNull()))
        if bucket_seconds:
            both = both.withColumn("_wf_b", F.floor(F.unix_seconds(F.col("_wf_at").cast("timestamp")) / bucket_seconds))
            by = [*by, "_wf_b"]
        # at one time, rows of the other side come first
        upto = Window.partitionBy(*by).orderBy("_wf_at", F.col("_wf_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_wf_r", F.last("_wf_r", ignorenulls=True).over(upto))
        if bucket_seconds:
            ends = theirs.withColumn("_wf_b", F.floor(F.unix_seconds(F.col("_wf_at").cast("timestamp")) / bucket_seconds)).groupBy(*by).agg(F.max_by("_wf_r", "_wf_at").alias("_wf_e"))
            spots = both.filter("_wf_l IS NOT NULL").select(*by).distinct().join(ends, by, "left")
            ends = ends.select(*by, "_wf_e").join(spots.select(*by), by, "left_anti").unionByName(spots)
            before = Window.partitionBy(*keys).orderBy("_wf_b").rowsBetween(Window.unboundedPreceding, -1)
            carried = ends.withColumn("_wf_c", F.last("_wf_e", ignorenulls=True).over(before)).select(*by, "_wf_c")
            out = out.filter("_wf_l IS NOT NULL").join(carried, by, "left").withColumn("_wf_r", F.coalesce("_wf_r", "_wf_c"))
        whole = F.col("_wf_at").isNotNull()
        for k in keys:
            whole = whole & k.isNotNull()
        found = [F.when(whole, F.col("_wf_r")[n]).alias(n) for n in take]
        return self._with(out.filter("_wf_l IS NOT NULL").select(*[F.col("_wf_l")[c].alias(c) for c in self.columns], *found))

    def join_range(self, other: Frame | DataFrame, value: str, low: str, high: str, width: float, how: str = "inner") -> Frame:
        """Rows with those of ``other`` whose [low, high] holds their value: an equality join on bins of ``width``, then the exact test.

        Choose the width near the usual length of the ranges: each range is repeated once per bin that it touches.
        """
        if how not in ("inner", "left"):
            raise ValueError(f"join_range is inner or left, not {how!r}")
        right = other.data if isinstance(other, Frame) else other
        bins = right.filter(F.col(low) <= F.col(high)).withColumn("_wf_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
        left = self.data.withColumn("_wf_bin", F.floor(F.col(value) / width)).alias("l")
        on = (F.col("l._wf_bin") == F.col("r._wf_bin")) & (F.col(f"l.`{value}`") >= F.col(f"r.`{low}`")) & (F.col(f"l.`{value}`") <= F.col(f"r.`{high}`"))
        return self._with(left.join(bins.alias("r"), on, how).drop("_wf_bin"))

    def join_theta(self, other: Frame | DataFrame, on: Any, how: str = "inner") -> Frame:
        """A join by any condition that holds at least one equality between the sides; anything else compares every pair, and is refused."""
        joined = self.join(other, on, how)
        plan = joined.data._jdf.queryExecution().sparkPlan().toString()
        if "NestedLoopJoin" in plan or "CartesianProduct" in plan:
            raise ValueError("a join without any equality compares every pair of rows; use join_range or join_asof")
        return joined

    def union(self, other: Frame, distinct: bool = False) -> Frame:
        both = self.data.unionByName(other.data, allowMissingColumns=True)
        return Frame(both.distinct() if distinct else both)

    def intersect(self, other: Frame) -> Frame:
        return Frame(self.data.intersect(other.data.select(*self.columns)))

    def except_(self, other: Frame) -> Frame:
        return Frame(self.data.subtract(other.data.select(*self.columns)))


class Grouped:
    def __init__(self, frame: Frame, names: list[str], kind: str = "groupBy") -> None:
        self.frame, self.names, self.kind = frame, names, kind

    def _edge(self, field: Column, last: bool) -> Column:
        """The first or last value that isn't null, in the frame's order."""
        order = self.frame.order or []
        upward = {k.ascending for k in order}
        if len(upward) > 1:
            at, flip = F.col("_wf_rank"), last
        else:
            down = upward == {False}
            # nulls come last either way: behind all values upward, before all values downward
            parts = [x for k in order for x in ((k.plain.isNotNull() if down else k.plain.isNull()), k.plain)]
            at, flip = F.struct(*parts, -F.col(_ORD) if down else F.col(_ORD)), last != down
        held = F.when(field.isNotNull(), at)
        return (F.max_by if flip else F.min_by)(field, held)

    def agg(self, *aggregates: Aggregate) -> Frame:
        """Keys and aggregates, in the order of the keys; rows with a null key are left out."""
        frame = self.frame
        frame._need(*[a.field for a in aggregates])
        keys = [F.col(f"`{n}`") for n in self.names]
        df = frame.data
        for k in keys:
            df = df.filter(k.isNotNull())
        if any(a.how in ("first", "last") for a in aggregates) or any(a.how == "sum" and self._is_text(a.field) for a in aggregates):
            df, sort = Frame(df, frame.order)._ordered()
            if len({k.ascending for k in frame.order or []}) > 1:
                df = df.withColumn("_wf_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)))
        out = getattr(df, self.kind)(*keys).agg(*[self._column(a).alias(a.name) for a in aggregates])
        return Frame(out, [asc(n) for n in self.names])

    def _is_text(self, field: str) -> bool:
        return isinstance(self.frame.data.schema[field].dataType, T.StringType)

    def _column(self, a: Aggregate) -> Column:
        c = F.col(f"`{a.field}`")
        if a.how == "sum" and self._is_text(a.field):
            pairs = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col(_ORD), c.alias("text")))))
            return F.array_join(F.transform(pairs, lambda p: p["text"]), "")
        simple = {"sum": lambda: F.coalesce(F.sum(c), F.lit(0)), "count": lambda: F.count(c), "mean": lambda: F.avg(c), "min": lambda: F.min(c), "max": lambda: F.max(c)}
        return simple[a.how]() if a.how in simple else self._edge(c, a.how == "last")


FRAME_METHODS = {"filter", "select", "drop", "rename", "dedup", "distinct", "order_by", "limit", "group_by", "rollup", "cube", "join", "join_asof", "join_range", "join_theta", "union", "intersect", "except_"}
CONDITION_METHODS = {"is_in", "is_null", "is_not_null", "between", "contains", "starts_with", "ends_with", "alias"}


def transform(df: DataFrame, expression: str, others: dict[str, DataFrame] | None = None) -> Frame:
    """Run a chain such as ``frame.filter(col("a") > 1).dedup(["k"])``."""
    scope = Scope(df)

    def scoped(name: str) -> Term:
        return Term(col(name).column, frozenset([name]), scope if name in df.columns else None)

    names: dict[str, Any] = {"frame": Frame(df), "col": scoped, "asc": asc, "desc": desc, "True": True, "False": False, "None": None, **AGGREGATES}
    names |= {k: Frame(v) for k, v in (others or {}).items()}
    out = Interpreter(names, {Frame: FRAME_METHODS, Grouped: {"agg"}, Aggregate: {"alias"}, Term: CONDITION_METHODS}).run(expression)
    if not isinstance(out, Frame):
        raise TypeError(f"a transform must return a Frame, not {type(out).__name__}")
    return out


__all__ = ["AGGREGATES", "Aggregate", "Frame", "Grouped", "Refused", "agg_count", "agg_first", "agg_last", "agg_max", "agg_mean", "agg_min", "agg_sum", "asc", "col", "desc", "transform"]
