"""Differences between two states of a table as change events, and the differing rows of two versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(side: str, columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def keys_match(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])


def compute_changes(new: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    """op, pk, before_data, after_data (JSON) of each row that differs: one full outer join on the key.

    Without an old state every row is an INSERT with its whole row; else images leave out the key. Nulls equal nulls.
    """
    if old is None:
        n = new.alias("n")
        return n.select(F.lit("INSERT").alias("op"), _json("n", keys).alias("pk"), F.lit(None).cast("string").alias("before_data"), _json("n", new.columns).alias("after_data"))
    rest = [c for c in new.columns if c not in keys]
    olds = [c for c in old.columns if c not in keys]
    n, o = new.withColumn("_wf_here", F.lit(True)).alias("n"), old.withColumn("_wf_here", F.lit(True)).alias("o")
    joined = n.join(o, keys_match("n", "o", keys), "full_outer")
    fresh, gone = F.col("o._wf_here").isNull(), F.col("n._wf_here").isNull()
    both = [c for c in rest if c in olds]
    differs = reduce(lambda x, y: x | y, [~F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in both], F.lit(set(rest) != set(olds)))
    op = F.when(fresh, "INSERT").when(gone, "DELETE").when(differs, "UPDATE")
    pk = F.when(gone, _json("o", keys)).otherwise(_json("n", keys))
    out = joined.select(op.alias("op"), pk.alias("pk"), F.when(~fresh, _json("o", olds)).alias("before_data"), F.when(~gone, _json("n", rest)).alias("after_data"))
    return out.filter("op IS NOT NULL")


def row_diff(new: DataFrame, old: DataFrame, keys: list[str], ts: str | None = None) -> DataFrame:
    """Rows of new that old lacks or has differently (change: new, changed). With ``ts`` the last row per key counts; nulls never equal."""
    def last(df: DataFrame) -> DataFrame:
        if ts is None:
            return df
        from pyspark.sql import Window

        n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last()))
        return df.withColumn("_wf_n", n).filter("_wf_n = 1").drop("_wf_n")

    rest = [c for c in new.columns if c not in keys and c in old.columns and c != ts]
    n, o = last(new).alias("n"), last(old).withColumn("_wf_here", F.lit(True)).alias("o")
    joined = n.join(o, reduce(lambda x, y: x & y, [F.col(f"n.`{k}`") == F.col(f"o.`{k}`") for k in keys]), "left")
    differs = reduce(lambda x, y: x | y, [~F.coalesce(F.col(f"n.`{c}`") == F.col(f"o.`{c}`"), F.lit(False)) for c in rest], F.lit(False))
    change = F.when(F.col("o._wf_here").isNull(), "new").when(differs, "changed")
    return joined.select(*[F.col(f"n.`{c}`").alias(c) for c in new.columns], change.alias("change")).filter("change IS NOT NULL")
