"""Column profiles of each load of a table, and the loads and columns that stand out.

Everything is derived from one table of counts by load, column and value. Its aggregates combine before the
shuffle and it is keyed by value too, so a load with a third of all rows is spread. Medians are exact: values are counted in
order-preserving buckets (1/16 of an octave), the bucket of the middle rank is found over the counts, and only its values are ranked.
Column expressions are induced by minimum description length (``expressions_mdl``) over the distinct values of all loads.
Rows are counted by load and expression, once; the expressions of a column are then the fewest that cover a typical load
(medians of their shares over the loads) up to the tolerance. Values of none of these are nonconforming. Nothing about the
values is given beforehand: a load stands out if more of its values than the tolerance leave the expressions of the others.

Defined results:
* a load whose name doesn't hold a branch and a date is its own branch without a date: no finding that needs either;
* NaN counts as null; null load names are one load (apart from an empty name), likewise without branch and date; a load of nulls
  only has no shares, ranges or medians;
* a column without values has no expressions and nothing that leaves them;
* an empty table gives no profile and no findings; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.expressions_mdl import Expression, facts, induce, skeletons
from weirflow.session import cut


#: Share of values (percent) that may lie outside of ranges and expressions.
STRAY = 4


@dataclass(frozen=True)
class Watched:
    """A column and what is held against it.

    kind: number, day or text. low, high: values outside are out of range (days: relative to the load's date, in days).
    expressions: as induced; typical: numbers of those that make up a typical load.
    """

    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    expressions: list[Expression] = field(default_factory=list)
    typical: tuple[int, ...] = ()


def _key() -> Column:
    """The name of a load, as a text that is never null."""
    return F.coalesce(F.concat(F.lit("f"), F.col("load")), F.lit("n")).alias("lk")


def value_counts(rows: DataFrame, load: str, columns: list[Watched]) -> DataFrame:
    """load, column, value (text; null for nulls), n."""
    def text(w: Watched) -> Column:
        c = F.col(w.name)
        return F.when(~F.isnan(c), c.cast("string")) if w.kind == "number" else c.cast("string")

    pairs = F.array(*[F.struct(F.lit(w.name).alias("column"), text(w).alias("value")) for w in columns])
    return rows.select(F.col(load).alias("load"), F.explode(pairs).alias("p")).groupBy("load", "p.column", "p.value").agg(F.count("*").alias("n"))


def load_dates(counts: DataFrame, pattern: str) -> DataFrame:
    """load, branch, day, previous (load). A load without branch and day has none of them."""
    names = counts.filter("load IS NOT NULL").select("load").distinct()
    names = names.select("load", F.regexp_extract("load", pattern, 1).alias("branch"), F.expr("try_cast(nullif(regexp_extract(load, :p, 2), '') as date)".replace(":p", "r'" + pattern + "'")).alias("day"))
    order = Window.partitionBy("branch").orderBy("day", "load")
    dated = names.filter("day IS NOT NULL").withColumn("previous", F.lag("load").over(order))
    return dated.unionByName(names.filter("day IS NULL").withColumn("previous", F.lit(None).cast("string")))


def _number_of(columns: list[Watched]) -> Column:
    """The number of the first induced expression of its column that a value matches whole; -1 if none does."""
    out = F.lit(-1)
    for w in columns:
        first = F.lit(-1)
        for i in reversed(range(len(w.expressions))):
            first = F.when(F.col("value").rlike(rf"^(?:{w.expressions[i].pattern})\z"), i).otherwise(first)
        out = F.when(F.col("column") == w.name, first).otherwise(out)
    return out


def induced(counts: DataFrame, columns: list[Watched], stray: int = STRAY) -> tuple[list[Watched], DataFrame]:
    """The columns with their expressions, and the rows of each: lk, load, column, expression (its number, -1 for none), n."""
    rows = facts(skeletons(counts))
    found = [Watched(w.name, w.kind, w.low, w.high, induce([r for r in rows if r["column"] == w.name])) for w in columns]
    shares = cut(counts.filter("value IS NOT NULL").groupBy(_key(), "load", "column", _number_of(found).alias("expression")).agg(F.sum("n").alias("n")), "coverage")
    return [typical(w, shares, stray) for w in found], shares


def typical(w: Watched, shares: DataFrame, stray: int = STRAY) -> Watched:
    """With the fewest expressions that cover a typical load up to ``stray`` percent: those of the greatest median share."""
    own = shares.filter(F.col("column") == w.name)
    wide = own.groupBy("lk").agg(F.sum("n").alias("held"), *[F.sum(F.when(F.col("expression") == i, F.col("n")).otherwise(0)).alias(f"e{i}") for i in range(len(w.expressions))])
    middle = wide.agg(*[F.median(F.col(f"e{i}") / F.col("held")) for i in range(len(w.expressions))]).first() if w.expressions else ()
    kept: list[int] = []
    covered = 0.0
    for share, i in sorted(((-(m or 0.0), i) for i, m in enumerate(middle))):
        if not share or covered * 100 >= 100 - stray:
            break
        kept.append(i)
        covered -= share
    return Watched(w.name, w.kind, w.low, w.high, w.expressions, tuple(sorted(kept)))


def _conforms(columns: list[Watched]) -> Column:
    out = F.lit(False)
    for w in columns:
        out = out | ((F.col("column") == w.name) & F.col("expression").isin(list(w.typical)))
    return out


def medians(numbers: DataFrame, by: list[str]) -> DataFrame:
    """by, median (mean of the two middle values for even counts). numbers: by, x (double), n."""
    size = F.floor(F.log2(F.abs("x")) * 16) + 20_000
    bucket = F.when(F.col("x") > 0, size).when(F.col("x") < 0, -size).otherwise(0)
    x = numbers.filter("x IS NOT NULL").withColumn("bucket", bucket)
    b = x.groupBy(*by, "bucket").agg(F.sum("n").alias("b"))
    order = Window.partitionBy(*by).orderBy("bucket")
    b = b.withColumns({"upto": F.sum("b").over(order), "total": F.sum("b").over(Window.partitionBy(*by))})
    b = b.withColumns({"lo": F.expr("(total + 1) div 2"), "hi": F.expr("total div 2 + 1")}).filter("(lo > upto - b AND lo <= upto) OR (hi > upto - b AND hi <= upto)")
    inner = Window.partitionBy(*by, "bucket").orderBy("x")
    v = x.join(b.withColumn("base", F.expr("upto - b")).select(*by, "bucket", "base", "lo", "hi"), [*by, "bucket"])
    v = v.groupBy(*by, "bucket", "x", "base", "lo", "hi").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(inner) + F.col("base"))
    low = F.max(F.when(F.expr("lo > upto - n AND lo <= upto"), F.col("x")))
    high = F.max(F.when(F.expr("hi > upto - n AND hi <= upto"), F.col("x")))
    return v.groupBy(*by).agg(((low + high) / 2).alias("median"))


def profile(counts: DataFrame, loads: DataFrame, columns: list[Watched], shares: DataFrame) -> DataFrame:
    """Per load and column: n, nulls, distinct, low, high, out_of_range, uncovered (by the column's expressions), median."""
    c = counts.join(loads.select("load", "day"), "load", "left")
    x = F.lit(None).cast("double")
    outside = F.lit(False)
    for w in columns:
        own = F.expr("try_cast(value as double)") if w.kind == "number" else F.datediff("day", F.expr("try_cast(value as date)")).cast("double") if w.kind == "day" else F.lit(None).cast("double")
        x = F.when(F.col("column") == w.name, own).otherwise(x)
        if w.low is not None:
            outside = F.when(F.col("column") == w.name, F.coalesce((F.col("x") < w.low) | (F.col("x") > w.high), F.lit(False))).otherwise(outside)
    c = c.select("*", _key(), x.alias("x"))
    held = F.col("value").isNotNull()
    n = F.col("n")
    stats = c.groupBy("lk", "load", "column").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(held, 0).otherwise(n)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.sum(F.when(held & outside, n).otherwise(0)).alias("out_of_range"),
        F.min("value").alias("least_text"),
        F.max("value").alias("greatest_text"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    middle = medians(c.filter("x IS NOT NULL").select("lk", "column", "x", "n"), ["lk", "column"])
    strays = shares.groupBy("lk", "column").agg(F.sum(F.when(_conforms(columns), 0).otherwise(n)).alias("uncovered"))
    out = stats.join(middle, ["lk", "column"], "left").join(strays, ["lk", "column"], "left")
    return out.withColumn("uncovered", F.coalesce("uncovered", F.lit(0)))


def coverage(stats: DataFrame, loads: DataFrame) -> DataFrame:
    """load, column, covered (share of values within the induced expressions), covered_before (in the load before), change."""
    share = F.try_divide(F.col("n") - F.col("nulls") - F.col("uncovered"), F.col("n") - F.col("nulls"))
    own = stats.select("load", "column", share.alias("covered"))
    before = own.select(F.col("load").alias("previous"), "column", F.col("covered").alias("covered_before"))
    out = own.join(loads.select("load", "previous"), "load", "left").join(before, ["previous", "column"], "left")
    return out.select("load", "column", "covered", "covered_before", (F.col("covered") - F.col("covered_before")).alias("change"))


def with_before(stats: DataFrame, loads: DataFrame) -> DataFrame:
    """stats with branch, day, and n_before, nulls_before, distinct_before, median_before, held_after of the neighbouring loads of the branch."""
    s = stats.join(loads.select("load", "branch", "day"), "load", "left")
    order = Window.partitionBy("branch", "column").orderBy("day", "load")
    dated = s.filter("day IS NOT NULL").withColumns({f"{c}_before": F.lag(c).over(order) for c in ("n", "nulls", "distinct", "median")} | {"held_after": F.lead(F.expr("n - nulls")).over(order), "next": F.lead("load").over(order)})
    return dated.unionByName(s.filter("day IS NULL"), allowMissingColumns=True)


def distances(counts: DataFrame, beside: DataFrame, columns: list[Watched]) -> DataFrame:
    """load, column, apart: the sum of absolute differences of the value shares of a load and the one before, times the values held by both.

    beside: of ``with_before``. Each count goes to its own load and to the next one of the branch, and these meet by value.
    """
    texts = [w.name for w in columns if w.kind == "text"]
    whole = lambda c: F.expr(c).cast("decimal(19,0)")
    at = beside.filter(F.col("column").isin(texts) & F.col("day").isNotNull()).select("load", "column", "next", whole("n - nulls").alias("held"), whole("n_before - nulls_before").alias("held_before"), whole("held_after").alias("held_after"))
    v = counts.filter(F.col("column").isin(texts) & F.col("value").isNotNull()).join(at, ["load", "column"])
    own = F.when(F.expr("held_before > 0"), F.struct(F.col("load"), (whole("n") * F.col("held_before")).alias("part")))
    ahead = F.when(F.expr("held_after > 0"), F.struct(F.col("next").alias("load"), (-whole("n") * F.col("held_after")).alias("part")))
    parts = v.select("column", "value", F.explode(F.array_compact(F.array(own, ahead))).alias("p")).select("p.load", "column", "value", "p.part")
    return parts.groupBy("load", "column", "value").agg(F.sum("part").alias("part")).groupBy("load", "column").agg(F.sum(F.abs("part")).alias("apart"))


def findings(
    counts: DataFrame,
    loads: DataFrame,
    stats: DataFrame,
    columns: list[Watched],
    stray: int = STRAY,
    null_change: int = 12,
    distinct_times: int = 2,
    median_times: float = 3,
    median_days: float = 5,
    distance: int = 35,
) -> DataFrame:
    """load, column, finding (range, pattern, null_rate, distinct, shift). Shares are thresholds in percent."""
    beside = with_before(stats, loads)
    s = beside.join(distances(counts, beside, columns), ["load", "column"], "left")
    kind = F.lit("")
    for w in columns:
        kind = F.when(F.col("column") == w.name, w.kind).otherwise(kind)
    held = F.col("n") - F.col("nulls")
    has = F.col("n_before").isNotNull()
    d = {c: F.col(c).cast("decimal(19,0)") for c in ("n", "nulls", "n_before", "nulls_before")}
    pattern = (kind == "text") & (F.col("uncovered") * 100 > stray * held)
    ratio = (F.col("median") > median_times * F.col("median_before")) | (F.col("median_before") > median_times * F.col("median"))
    shift = F.when(kind == "number", ratio).when(kind == "day", F.abs(F.col("median") - F.col("median_before")) > median_days).otherwise(F.col("apart") * 100 > F.expr("cast(n - nulls as decimal(19,0)) * cast(n_before - nulls_before as decimal(19,0))") * 2 * distance)
    tests = {
        "range": F.col("out_of_range") * 100 > stray * held,
        "pattern": pattern,
        "null_rate": has & (F.abs(d["nulls"] * d["n_before"] - d["nulls_before"] * d["n"]) * 100 > d["n"] * d["n_before"] * null_change),
        "distinct": has & ((F.col("distinct") > distinct_times * F.col("distinct_before")) | (F.col("distinct_before") > distinct_times * F.col("distinct"))),
        "shift": has & shift,
    }
    return s.select("load", "column", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]))).alias("finding"))
