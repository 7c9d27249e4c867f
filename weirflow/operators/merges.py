"""Writes as plans: upsert, delete and insert, and versioned history. Each takes the current rows and gives the next."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.changes import keys_match

SYSTEM = ["valid_from", "valid_to", "is_current", "is_deleted"]


_PASSING = ("Project", "Filter", "SubqueryAlias", "LocalLimit", "GlobalLimit", "Generate", "View")
_LEAVES = ("Relation", "LogicalRDD", "LocalRelation", "Range", "LogicalQueryStage", "CollectMetrics")


def ordered(df: DataFrame) -> bool:
    """Whether rows come in an order of their own: sorted, or as a source gives them, with nothing between that shuffles."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        name = plan.nodeName()
        if name == "Sort":
            return bool(getattr(plan, "global")())
        if name.startswith(_LEAVES) or not plan.children().size():
            return True
        if name not in _PASSING or plan.children().size() != 1:
            return False
        plan = plan.children().apply(0)


def last_per_key(batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The last row of each key; in reading order where no order is given."""
    df = batch.withColumn("_wf_o", F.monotonically_increasing_id())
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or []), F.col("_wf_o").desc()))
    return df.withColumn("_wf_n", n).filter("_wf_n = 1").drop("_wf_n", "_wf_o")


def merged(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch replace those of the same key; of repeated keys in the batch the last counts."""
    source = last_per_key(batch, keys)
    kept = target.join(source.select(*keys), keys, "left_anti")
    return kept.unionByName(source, allowMissingColumns=True).select(*target.columns, *[c for c in batch.columns if c not in target.columns])


def replaced(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key is in the batch go, all rows of the batch come, repeated ones too."""
    kept = target.join(batch.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def opened(batch: DataFrame, now: datetime) -> DataFrame:
    """Rows as the first versions of a history."""
    return batch.withColumns({"valid_from": F.lit(now).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True), "is_deleted": F.lit(False)})


def versioned(
    target: DataFrame,
    batch: DataFrame,
    keys: list[str],
    now: datetime,
    strategy: str,
    updated_at: str | None = None,
    check_cols: list[str] | str | None = None,
    hard_deletes: str = "ignore",
    tombstones: bool = False,
    carry: list[str] | None = None,
) -> DataFrame:
    """The history after a full batch: one outer join of the current versions with the batch.

    carry: columns of the target that aren't its data (positions). Then only what changes is given: closed versions
    with these columns of the version they end, and new ones without.

    strategy "check": changed if any checked column differs (all columns but keys for "all"); "timestamp": changed if
    ``updated_at`` is later. Keys that the batch lacks stay ("ignore"), are closed and marked ("invalidate"), or closed only
    ("new_record"; with ``tombstones`` a deleted version is added). A key without current version is new. The batch must hold each key once.
    """
    extra = carry or []
    columns = [c for c in target.columns if c not in (*SYSTEM, *extra)]
    rest = [c for c in columns if c not in keys]
    history = target.filter(~F.col("is_current"))
    o = target.filter("is_current").withColumn("_wf_here", F.lit(True)).alias("o")
    n = batch.select(*[F.col(f"`{c}`") if c in batch.columns else F.lit(None).alias(c) for c in columns]).withColumn("_wf_here", F.lit(True)).alias("n")
    has, hit = F.coalesce(F.col("o._wf_here"), F.lit(False)), F.coalesce(F.col("n._wf_here"), F.lit(False))
    if strategy == "timestamp":
        differs = F.coalesce(F.col(f"n.`{updated_at}`") > F.col(f"o.`{updated_at}`"), F.lit(False))
    elif strategy == "check":
        checked = rest if check_cols == "all" else list(check_cols or [])
        differs = reduce(lambda a, b: a | b, [~F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in checked], F.lit(False))
    else:
        raise ValueError(f"unknown snapshot strategy '{strategy}'")
    changed = has & hit & differs
    gone = has & ~hit & F.lit(hard_deletes != "ignore")
    closes = changed | gone
    moment = F.lit(now).cast("timestamp")

    def version(side: str, start: Column, end: Column, current: Column, deleted: Column, not_tomb: bool = True) -> Column:
        data = [F.col(f"{side}.`{c}`").alias(c) for c in columns]
        more = [(F.col(f"o.`{c}`") if side == "o" and not_tomb else F.lit(None).cast(target.schema[c].dataType)).alias(c) for c in extra]
        return F.struct(*data, start.alias("valid_from"), end.alias("valid_to"), current.alias("is_current"), deleted.alias("is_deleted"), *more)

    kept = version("o", F.col("o.valid_from"), F.when(closes, moment).otherwise(F.col("o.valid_to")), ~closes, F.col("o.is_deleted") | (gone & F.lit(hard_deletes == "invalidate")))
    fresh = version("n", moment, F.lit(None).cast("timestamp"), F.lit(True), F.lit(False))
    parts = [F.when(closes if carry else has, kept), F.when((~has & hit) | changed, fresh)]
    if tombstones and hard_deletes == "new_record":
        parts.append(F.when(gone, version("o", moment, F.lit(None).cast("timestamp"), F.lit(True), F.lit(True), False)))
    rows = o.join(n, keys_match("o", "n", keys), "full_outer").select(F.explode(F.array_compact(F.array(*parts))).alias("v")).select("v.*")
    if carry:
        return rows
    return history.select(*columns, *SYSTEM).unionByName(rows.select(*columns, *SYSTEM))


def repeated_keys(batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.groupBy(*keys).count().filter("count > 1")
