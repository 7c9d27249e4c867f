"""History of changing attributes: presence bitmaps per entity and attribute hash, and their runs of bits.

For every pair of an entity and the hash of its attributes one bit is set per snapshot (or per update, numbered in the
order of its time) in which the pair holds. A run of consecutive bits is one version; a gap ends it by itself.
Bitmaps are cut into words of 63 bits, so their number is not bounded, and a bit at the edge of a word looks at the
neighbouring word of the same pair.

Rows are reduced to one per entity and time (partial aggregation), then partitioned and sorted once, by ranges of entity and, for
updates, time: an entity with a third of all updates is spread over as many ranges as it needs. Each range builds its bitmaps at once
in arrays. What reaches over the border of ranges are the first and the last version of each range's first and last entity: at most two small
rows a range, which are put together by a window per entity.

Defined results:
* rows with a null in the key, or without a snapshot date or update time, are ignored;
* of several rows for one key and snapshot (or update time) the one with the latest updated_at (or highest tie-break) counts,
  among equals the one with the greatest attributes;
* attributes are equal if all are equal, null being equal only to null;
* an empty table gives no versions; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.snapshot_diff import exact_text, folded_key, one_per_snapshot
from weirflow.session import cut

WORD = 63
_MASK = np.uint64((1 << WORD) - 1)
_ONE, _TOP = np.uint64(1), np.uint64(WORD - 1)


def attribute_hash(text: Column) -> list[Column]:
    """128 bits of an exact text, as two numbers."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def numbered_groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal tuples together, and the number of each row's tuple in that order."""
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), dtype=bool)
    for c in columns:
        s = c[by]
        new[1:] |= s[1:] != s[:-1]
    return by, np.cumsum(new)


def bitmaps(pair: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, word and bits of each word that has any, in order."""
    word, bit = np.divmod(pos, WORD)
    by = np.lexsort((word, pair))
    p, w, one = pair[by], word[by], _ONE << bit[by].astype(np.uint64)
    if not len(p):
        return p, w, one
    edge = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (w[1:] != w[:-1])]))
    return p[edge], w[edge], np.bitwise_or.reduceat(one, edge)


def _positions(marks: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word, and position, of every bit that is set, in order."""
    at = np.flatnonzero(marks)
    bits = np.unpackbits(marks[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return at[row], word[at[row]] * WORD + bit


def runs(pair: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, first and last position of every run of consecutive bits, in the order of pairs and positions."""
    p, w, bits = bitmaps(pair, pos)
    if not len(p):
        return p, w, w
    follows = np.zeros(len(p), dtype=bool)
    follows[1:] = (p[1:] == p[:-1]) & (w[1:] == w[:-1] + 1)
    before, after = np.zeros_like(bits), np.zeros_like(bits)
    before[1:][follows[1:]] = (bits[:-1] >> _TOP)[follows[1:]]
    after[:-1][follows[1:]] = (bits[1:] & _ONE)[follows[1:]]
    row, first = _positions(bits & ~(((bits << _ONE) & _MASK) | before), w)
    _, last = _positions(bits & ~((bits >> _ONE) | (after << _TOP)), w)
    return p[row], first, last


class _Range:
    """The rows of one sorted range: entities as numbers in their order, hashes and times."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        held = [b for b in batches if b.num_rows]
        self.empty = not held
        if self.empty:
            return
        t = pa.Table.from_batches(held)
        names = t.column("key").combine_chunks().cast(pa.large_string())
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        new = np.concatenate([[True], pa.compute.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)]) if len(names) > 1 else np.array([True])
        self.begins = np.flatnonzero(new)
        self.entity = np.cumsum(new) - 1
        self.names = names.take(pa.array(self.begins))
        self.at = t.column("at").combine_chunks()
        self.h1, self.h2 = (t.column(c).to_numpy() for c in ("h1", "h2"))

    def versions(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entity, first and last position of every version, in the order of entities and positions."""
        by, group = numbered_groups(self.entity, self.h1, self.h2)
        pair = np.empty(len(by), dtype=np.int64)
        pair[by] = group
        p, first, last = runs(pair, pos)
        owner = self.entity[by[np.searchsorted(group, p)]]
        order = np.lexsort((first, owner))
        return owner[order], first[order], last[order]


def _ranges(df: DataFrame, rows: int, per_range: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_range))


def snapshot_history(rows: DataFrame, keys: list[str], snapshot: str, checked: list[str], updated_at: str | None = None, rows_per_range: int = 1_000_000) -> DataFrame:
    """record_key, valid_from, valid_to (dates; null while it holds) of each version, from full snapshots."""
    spark = rows.sparkSession
    counted = rows.filter(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).cast("date").alias("at")).count().orderBy("at").collect()
    dates = np.array([r["at"] for r in counted], dtype="datetime64[D]")
    schema = "record_key string, valid_from date, valid_to date"
    if not len(dates):
        return spark.createDataFrame([], schema)
    single = one_per_snapshot(rows, keys, snapshot, checked, updated_at).select("key", F.col("snap").alias("at"), *attribute_hash(F.col("checked")))
    # an entity has a row per snapshot at most, so it needn't be split
    ranged = single.repartitionByRange(_ranges(rows, sum(r["count"] for r in counted), rows_per_range), "key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Range(batches)
        if r.empty:
            return
        pos = np.searchsorted(dates, r.at.to_numpy(zero_copy_only=False).astype("datetime64[D]"))
        entity, first, last = r.versions(pos)
        ends = pa.array(np.append(dates, dates[-1])[last + 1], mask=last + 1 >= len(dates), type=pa.date32())
        yield pa.RecordBatch.from_arrays([r.names.take(pa.array(entity)).cast(pa.string()), pa.array(dates[first], pa.date32()), ends], names=["record_key", "valid_from", "valid_to"])

    return ranged.mapInArrow(run, schema)


def update_history(rows: DataFrame, keys: list[str], time: str, checked: list[str], tie: str, rows_per_range: int = 1_000_000) -> DataFrame:
    """record_key, valid_from, valid_to (timestamps; null while it holds) of each version, from updates.

    Of several updates of one entity at one time the one with the highest ``tie`` counts.
    """
    whole = F.col(time).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    kind = rows.schema[time].dataType.simpleString()
    picked = rows.filter(whole).select(folded_key(keys).alias("key"), F.col(time).alias("at"), F.col(tie).cast("bigint").alias("tie"), exact_text(checked).alias("checked"))
    single = picked.groupBy("key", "at").agg(F.max(F.struct(F.coalesce("tie", F.lit(-(1 << 63))).alias("tie"), "checked")).alias("row"))
    points = single.select("key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), *attribute_hash(F.col("row.checked")))
    ranged = points.repartitionByRange(_ranges(rows, rows.count(), rows_per_range), "key", "at").sortWithinPartitions("key", "at")
    names = ["record_key", "valid_from", "valid_to", "range", "second", "last", "first_hash", "last_hash"]
    schema = "record_key string, valid_from bigint, valid_to bigint, range int, second bigint, last bigint, first_hash binary, last_hash binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _Range(batches)
        if r.empty:
            return
        at = r.at.to_numpy()
        pos = np.arange(len(at)) - r.begins[r.entity]
        entity, first, _ = r.versions(pos)
        start = at[r.begins[entity] + first]
        n = len(entity)
        goes_on = np.append(entity[1:] == entity[:-1], False)
        end = np.append(start[1:], 0)
        # versions of the first and last entity may reach over the borders of the range
        edges = sorted({0, len(r.begins) - 1})
        kept = np.ones(n, dtype=bool)
        rest = []
        for e in edges:
            own = np.flatnonzero(entity == e)
            kept[own[[0, -1]]] = False
            a, b = r.begins[e], (r.begins[e + 1] if e + 1 < len(r.begins) else len(at)) - 1
            rest.append([r.names[e].as_py(), int(start[own[0]]), None, TaskContext.get().partitionId(), int(start[own[1]]) if len(own) > 1 else None, int(start[own[-1]]), r.h1[a].tobytes() + r.h2[a].tobytes(), r.h1[b].tobytes() + r.h2[b].tobytes()])
        whole_ = np.flatnonzero(kept)
        none = pa.nulls(len(whole_), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [r.names.take(pa.array(entity[whole_])).cast(pa.string()), pa.array(start[whole_]), pa.array(end[whole_], mask=~goes_on[whole_]), pa.nulls(len(whole_), pa.int32()), none, none, pa.nulls(len(whole_), pa.binary()), pa.nulls(len(whole_), pa.binary())],
            names=names,
        )
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rest), kinds)], names=names)

    found = cut(ranged.mapInArrow(run, schema), "versions")
    by = Window.partitionBy("record_key").orderBy("range")
    edge = found.filter("range IS NOT NULL").withColumn("goes_on", F.coalesce(F.lag("last_hash").over(by) == F.col("first_hash"), F.lit(False)))
    edge = edge.withColumn("opens", F.when(F.col("goes_on"), F.col("second")).otherwise(F.col("valid_from")))
    edge = edge.withColumn("next", F.first("opens", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    first = F.when(~F.col("goes_on"), F.struct(F.col("valid_from"), F.coalesce("second", "next").alias("valid_to")))
    last = F.when(F.col("second").isNotNull(), F.struct(F.col("last").alias("valid_from"), F.col("next").alias("valid_to")))
    ends = edge.select("record_key", F.explode(F.array_compact(F.array(first, last))).alias("v")).select("record_key", "v.*")
    out = found.filter("range IS NULL").select("record_key", "valid_from", "valid_to").unionByName(ends)
    return out.select("record_key", *[F.timestamp_micros(c).cast(kind).alias(c) for c in ("valid_from", "valid_to")])
