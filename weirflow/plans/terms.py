"""Terms: columns with what the expression language knows of them (the fields they read, how to tell their type)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


WHOLE = "_wf_whole"


class Scope:
    """The frame that expressions read, and the run they belong to."""

    def __init__(self, df: DataFrame, run: Any = None) -> None:
        self.df, self.run = df, run
        self.wholes: list[Column] = []

    def whole(self, aggregate: Column) -> Column:
        """An aggregate of all rows, as a value of every row. All of a scope are computed by one subquery, in one scan."""
        self.wholes.append(aggregate.alias(f"a{len(self.wholes)}"))
        return F.col(WHOLE)[f"a{len(self.wholes) - 1}"]

    def frame(self) -> DataFrame:
        """The frame that compiled columns are selected from."""
        return self.df.withColumn(WHOLE, self.df.agg(F.struct(*self.wholes)).scalar()) if self.wholes else self.df

    def type_of(self, c: Column) -> T.DataType:
        return self.frame().select(c.alias("c")).schema["c"].dataType

    def field(self, name: str) -> Term:
        if name not in self.df.columns:
            raise KeyError(f"no column '{name}'; there are {', '.join(self.df.columns)}")
        return Term(F.col(f"`{name}`"), frozenset([name]), self)


def column_of(x: Any) -> Column:
    return x.column if isinstance(x, Term) else x if isinstance(x, Column) else F.lit(x)


def refs_of(items: Iterable[Any]) -> frozenset[str]:
    out: frozenset[str] = frozenset()
    for x in items:
        if isinstance(x, Term):
            out |= x.refs
        elif isinstance(x, (list, tuple)):
            out |= refs_of(x)
        elif isinstance(x, dict):
            out |= refs_of(x.values())
    return out


class Term:
    """A column expression. Comparisons and arithmetic make new terms; nulls follow SQL unless a method says otherwise."""

    __hash__ = None  # terms compare to terms

    def __init__(self, column: Column, refs: frozenset[str] = frozenset(), scope: Scope | None = None) -> None:
        self.column, self.refs, self.scope = column, refs, scope

    def _with(self, column: Column, *others: Any) -> Term:
        scope = self.scope or next((o.scope for o in others if isinstance(o, Term) and o.scope), None)
        return Term(column, self.refs | refs_of(others), scope)

    def kind(self) -> T.DataType | None:
        return self.scope.type_of(self.column) if self.scope else None

    def _binary(self, other: Any, f: Callable[[Column, Column], Column], swapped: bool = False) -> Term:
        a, b = self.column, column_of(other)
        return self._with(f(b, a) if swapped else f(a, b), other)

    def _is_text(self, other: Any) -> bool:
        if isinstance(other, str) or isinstance(self.kind(), T.StringType):
            return True
        return isinstance(other, Term) and isinstance(other.kind(), T.StringType)

    def __add__(self, other: Any) -> Term:
        return self._binary(other, F.concat if self._is_text(other) else lambda a, b: a + b)

    def __radd__(self, other: Any) -> Term:
        return self._binary(other, F.concat if self._is_text(other) else lambda a, b: a + b, swapped=True)

    def __sub__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a - b)

    def __rsub__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a - b, swapped=True)

    def __mul__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a * b)

    __rmul__ = __mul__

    # division by zero is null: there is no infinite value in a table
    def __truediv__(self, other: Any) -> Term:
        return self._binary(other, F.try_divide)

    def __rtruediv__(self, other: Any) -> Term:
        return self._binary(other, F.try_divide, swapped=True)

    def __floordiv__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: F.floor(F.try_divide(a, b)))

    def __rfloordiv__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: F.floor(F.try_divide(a, b)), swapped=True)

    def __mod__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a - b * F.floor(F.try_divide(a, b)))

    def __rmod__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a - b * F.floor(F.try_divide(a, b)), swapped=True)

    def __pow__(self, other: Any) -> Term:
        return self._binary(other, F.pow)

    def __neg__(self) -> Term:
        return self._with(-self.column)

    def __eq__(self, other: Any) -> Term:  # type: ignore[override]
        return self._binary(other, lambda a, b: a == b)

    def __ne__(self, other: Any) -> Term:  # type: ignore[override]
        return self._binary(other, lambda a, b: a != b)

    def __lt__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a < b)

    def __le__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a <= b)

    def __gt__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a > b)

    def __ge__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a >= b)

    def __and__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a & b)

    __rand__ = __and__

    def __or__(self, other: Any) -> Term:
        return self._binary(other, lambda a, b: a | b)

    __ror__ = __or__

    def __invert__(self) -> Term:
        return self._with(~self.column)

    def __bool__(self) -> bool:
        raise TypeError("a term has no truth value; use & | ~")

    def is_in(self, values: list) -> Term:
        """Membership; null is in no list, also under negation."""
        return self._with(F.coalesce(self.column.isin(list(values)), F.lit(False)))

    def is_null(self) -> Term:
        return self._with(self.column.isNull())

    def is_not_null(self) -> Term:
        return self._with(self.column.isNotNull())

    def between(self, low: Any, high: Any) -> Term:
        return self._with(self.column.between(column_of(low), column_of(high)), low, high)

    def contains(self, pattern: str, case: bool = True) -> Term:
        """Search for a regular expression; null holds none."""
        return self._with(F.coalesce(self.column.rlike(pattern if case else f"(?i){pattern}"), F.lit(False)))

    def starts_with(self, prefix: str) -> Term:
        return self._with(F.coalesce(self.column.startswith(prefix), F.lit(False)))

    def ends_with(self, suffix: str) -> Term:
        return self._with(F.coalesce(self.column.endswith(suffix), F.lit(False)))

    def alias(self, name: str) -> Term:
        return self._with(self.column.alias(name))


def col(name: str) -> Term:
    """A field of whatever frame the term is used on."""
    return Term(F.col(f"`{name}`"), frozenset([name]))
