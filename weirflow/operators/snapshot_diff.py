"""What changed between consecutive full snapshots: a two-pointer merge over sorted key ranges.

Rows are first reduced to one per key and snapshot (partial aggregation, so a key repeated by the million moves as a few
rows), then range-partitioned by key and sorted by snapshot and key inside each range. A task streams its range: of the snapshot before
it holds the sorted keys and compared columns, and merges them with those of the next. The merge goes by blocks: one pointer into
each of the two sorted runs, moved together to the last key that both blocks reach; what lies between is compared in arrays. A
range holds the keys of one partition, whose number follows the data (the session's shuffle partitions at least,
``rows_per_range`` at most per snapshot), so what a task holds is bounded.

``SnapshotStore`` keeps the snapshots as they are delivered: each is sorted once, by the ranges that the first one set, and
the next delivery reads back, range by range, only the one before it.

Defined results:
* the first snapshot of the table gives no rows; a snapshot without rows of a range still counts for that range;
* rows with a null in the key or without a snapshot date are ignored;
* of several rows for one key and snapshot the one with the latest ``updated_at`` counts (null is earliest), among equals the one
  with the greatest compared columns; without ``updated_at`` only the latter;
* compared columns differ if they aren't equal, null being equal only to null; NaN equals NaN;
* an empty table, or one with a single snapshot, gives no rows; other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.tables import Files
from weirflow.session import cut, opened


def folded_key(columns: list[str]) -> Column:
    """Keys without outer blanks and tabs, in upper case, joined by a bar; null if any is null."""
    return F.concat_ws("|", *[F.upper(F.regexp_replace(F.col(c).cast("string"), r"^[ \t]+|[ \t]+$", "")) for c in columns])


def exact_text(columns: list[str]) -> Column:
    """One string per combination of values: equal strings if and only if the values are equal, null only to null."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(*parts) if parts else F.lit("")


def one_per_snapshot(rows: DataFrame, keys: list[str], snapshot: str, checked: list[str], updated_at: str | None) -> DataFrame:
    """key, snap, checked: a single row per key and snapshot."""
    whole = F.lit(True)
    for k in [*keys, snapshot]:
        whole = whole & F.col(k).isNotNull()
    last = F.coalesce(F.unix_micros(F.col(updated_at).cast("timestamp")), F.lit(-(1 << 63))) if updated_at else F.lit(0)
    picked = rows.filter(whole).select(folded_key(keys).alias("key"), F.col(snapshot).cast("date").alias("snap"), last.alias("last"), exact_text(checked).alias("checked"))
    return picked.groupBy("key", "snap").agg(F.max(F.struct("last", "checked")).alias("row")).select("key", "snap", F.col("row.checked").alias("checked"))


BLOCK = 65_536


def _upto(keys: pa.Array, key: object, at: int) -> int:
    """How many of a sorted run's keys, from ``at`` on, come up to key."""
    lo, hi = at, len(keys)
    while lo < hi:
        mid = (lo + hi) // 2
        if keys[mid].as_py() <= key:
            lo = mid + 1
        else:
            hi = mid
    return lo


def merge_runs(old_keys: pa.Array, old_rows: pa.Array, new_keys: pa.Array, new_rows: pa.Array, block: int = BLOCK) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys that differ between two runs sorted by key (each without repeats), and how; block by block, in the order of keys."""
    i = j = 0
    while i < len(old_keys) or j < len(new_keys):
        # both pointers move to the smaller of the keys that a block more would reach
        ends = [keys[min(at + block, len(keys)) - 1].as_py() for keys, at in ((old_keys, i), (new_keys, j)) if at < len(keys)]
        key = min(ends)
        to_i, to_j = _upto(old_keys, key, i), _upto(new_keys, key, j)
        a, b = old_keys.slice(i, to_i - i), new_keys.slice(j, to_j - j)
        spot = pc.index_in(b, value_set=a)
        both = pc.is_valid(spot).to_numpy(zero_copy_only=False)
        there = spot.drop_null().to_numpy(zero_copy_only=False)
        gone = np.ones(len(a), dtype=bool)
        gone[there] = False
        here = np.flatnonzero(both)
        differs = pc.not_equal(old_rows.slice(i, to_i - i).take(pa.array(there)), new_rows.slice(j, to_j - j).take(pa.array(here))).to_numpy(zero_copy_only=False)
        parts = [(a.filter(pa.array(gone)), "removed"), (b.filter(pa.array(~both)), "added"), (b.take(pa.array(here[differs])), "changed")]
        keys = pa.concat_arrays([k for k, _ in parts])
        if len(keys):
            yield keys, pa.concat_arrays([pa.repeat(pa.scalar(kind), len(k)) for k, kind in parts])
        i, j = to_i, to_j


def snapshot_changes(rows: DataFrame, keys: list[str], snapshot: str, checked: list[str], updated_at: str | None = None, rows_per_range: int = 1_000_000) -> DataFrame:
    """record_key, snapshot_dt (date), change (added, removed, changed) of every snapshot against the one before it."""
    spark = rows.sparkSession
    single = one_per_snapshot(rows, keys, snapshot, checked, updated_at)
    # dates of the table: one small row per snapshot; the number of rows of the largest sets the number of ranges
    counted = rows.filter(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).cast("date").alias("snap")).count().orderBy("snap").collect()
    dates = [r["snap"] for r in counted]
    if len(dates) < 2:
        return spark.createDataFrame([], "record_key string, snapshot_dt date, change string")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(r["count"] for r in counted) // rows_per_range))
    sorted_rows = single.repartitionByRange(ranges, "key").sortWithinPartitions("snap", "key")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (pa.array([], pa.string()), pa.array([], pa.string()))
        at, old, parts = 0, empty, []

        def close() -> Iterator[pa.RecordBatch]:
            """Merge the run gathered for dates[at] with the one before it."""
            nonlocal old, parts
            new = tuple(pa.concat_arrays([p[k] for p in parts]) for k in (0, 1)) if parts else empty
            before, old, parts = old, new, []
            if at:
                for k, kinds in merge_runs(*before, *new):
                    yield pa.RecordBatch.from_arrays([k, pa.repeat(pa.scalar(dates[at], pa.date32()), len(k)), kinds], names=["record_key", "snapshot_dt", "change"])

        for b in batches:
            snaps = b.column("snap").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            edges = [0, *(np.flatnonzero(snaps[1:] != snaps[:-1]) + 1).tolist(), len(snaps)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                while np.datetime64(dates[at]) != snaps[lo]:
                    yield from close()
                    at += 1
                parts.append((b.column("key").slice(lo, hi - lo).cast(pa.string()), b.column("checked").slice(lo, hi - lo).cast(pa.string())))
        while at < len(dates):
            yield from close()
            at += 1

    return sorted_rows.mapInArrow(stream, "record_key string, snapshot_dt date, change string")


class SnapshotStore:
    """Snapshots as they are delivered, each kept sorted by key in the same ranges, behind a manifest.

    The first snapshot sets the ranges (``rows_per_range``); every other is cut at the same keys. The difference of two snapshots
    reads each range of both once, in its order, and nothing is sorted or shuffled again.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], checked: list[str], updated_at: str | None = None) -> None:
        self.spark, self.root, self.keys, self.checked, self.updated_at = spark, root.rstrip("/"), keys, checked, updated_at
        self.files = Files(spark, self.root)

    def _state(self) -> dict:
        return json.loads(self.files.read(f"{self.root}/manifest.json") or '{"bounds": null, "snapshots": []}')

    def add(self, rows: DataFrame, at: str, rows_per_range: int = 1_000_000) -> DataFrame:
        """Keep a snapshot under a name (its date), and give record_key, change against the one before it."""
        state = self._state()
        if state["snapshots"] and at <= state["snapshots"][-1]:
            raise ValueError(f"a snapshot of {state['snapshots'][-1]} is there already")
        single = one_per_snapshot(rows.withColumn("_wf_snap", F.lit("2000-01-01").cast("date")), self.keys, "_wf_snap", self.checked, self.updated_at).select("key", "checked")
        folder = f"{self.root}/at={at}"
        self.files.remove(folder)
        if state["bounds"] is None:
            staged = cut(single, "snapshot")
            n = staged.count()
            ranges = max(1, -(-n // rows_per_range))
            sample = staged.sample(min(1.0, 200.0 * ranges / max(1, n)), seed=7).orderBy("key").select("key")
            picked = [r["key"] for r in sample.limit(100_000).collect()] if ranges > 1 else []
            state["bounds"] = sorted({picked[len(picked) * i // ranges] for i in range(1, ranges)}) if picked else []
            single = staged
        bounds = state["bounds"]
        number = self._range_of(bounds)
        single.withColumn("range", number("key")).repartition(max(1, len(bounds) + 1), "range").sortWithinPartitions("range", "key").write.partitionBy("range").parquet(folder)
        before = state["snapshots"][-1] if state["snapshots"] else None
        state["snapshots"].append(at)
        self.files.replace(f"{self.root}/manifest.json", json.dumps(state))
        return self.between(before, at) if before else self.spark.createDataFrame([], "record_key string, change string")

    @staticmethod
    def _range_of(bounds: list[str]):  # noqa: ANN205
        ends = np.array(bounds, dtype=object)

        @F.pandas_udf("int")
        def number(key: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(ends, key.to_numpy(dtype=object), side="right").astype(np.int32))

        return number

    def between(self, old: str, new: str) -> DataFrame:
        """record_key, change from one kept snapshot to another."""
        root, n = self.root, len(self._state()["bounds"]) + 1
        for at in (old, new):
            if at not in self._state()["snapshots"]:
                raise ValueError(f"no snapshot of {at}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.column("id").to_pylist():
                    for k, kinds in merge_runs(*_sorted_range(root, old, part), *_sorted_range(root, new, part)):
                        yield pa.RecordBatch.from_arrays([k, kinds], names=["record_key", "change"])

        return self.spark.range(0, n, 1, min(n, 10_000)).mapInArrow(run, "record_key string, change string")


def _sorted_range(root: str, at: str, part: int) -> tuple[pa.Array, pa.Array]:
    """Keys and compared columns of one range of a kept snapshot."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    place, inner = opened(root)
    found = place.get_file_info(fs.FileSelector(f"{inner}/at={at}/range={part}", allow_not_found=True))
    tables = [pq.ParquetFile(place.open_input_file(f.path)).read(columns=["key", "checked"]) for f in found if f.path.endswith(".parquet")]
    if not tables:
        return pa.array([], pa.string()), pa.array([], pa.string())
    t = pa.concat_tables(tables)  # one file a range: its rows went through one task
    if len(tables) > 1:
        t = t.sort_by("key")
    return tuple(pa.concat_arrays(t.column(c).cast(pa.string()).chunks or [pa.array([], pa.string())]) for c in ("key", "checked"))
