"""Exactly one copy of each message: a persisted index of sorted identifier arrays.

The index is a list of immutable runs in a folder, named by a manifest. A run holds, for each prefix of the 128-bit identifier
hash, one sorted array. A batch is spread by prefix; the task of a prefix opens only the arrays of its prefix,
looks all identifiers of the batch up by binary search, drops the known ones, reduces the novel ones to one copy each, and
writes these as the array of a new run. When ``merge_at`` runs have gathered they are merged into one. Nothing is kept
in memory between batches, a task that is run again writes the same files, and a batch counts once the manifest names its run, so
another session can open the index and go on with it.

Before the shuffle each task reduces its rows to one copy per identifier, a block of ``BLOCK_ROWS`` at a time; what that drops is surplus
for certain and is written where it is. Of an identifier that a third of all rows share, one row per block is shuffled. The number of prefixes
follows the number of rows (``rows_per_group``).

Two identifiers count as equal if both their 64-bit hashes under different seeds are equal: at 10^10 identifiers
the chance of any false match is below 10^-18.

Defined results of ``surplus_copies``:
* rows with a null in the identifier are never surplus and never indexed;
* of equal identifiers the row with the lowest (order, row id) stays; a null order or row id (or one of 2^63 - 1) comes last;
* an empty table gives no rows; columns besides the named ones aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.tables import Files
from weirflow.session import opened, scratch

LAST = (1 << 63) - 1
RUN_SCHEMA = "source string, row_id bigint, seq int, ids binary, batch int, kind string, part int"
LOCAL_SCHEMA = "source string, h1 bigint, h2 bigint, ord bigint, row_id bigint, surplus boolean"
BLOCK_IDS = 1 << 20
#: Rows that a task reduces at a time (some 60 bytes each).
BLOCK_ROWS = 1_000_000


def id_array(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """128-bit identifiers as byte strings that sort like the pair of unsigned numbers."""
    both = np.empty((len(h1), 2), dtype=">u8")
    both[:, 0], both[:, 1] = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
    return both.reshape(-1).view("S16")


def known_in(ids: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which ids a sorted run holds, by binary search."""
    if not len(run) or not len(ids):
        return np.zeros(len(ids), dtype=bool)
    at = np.searchsorted(run, ids)
    return run[np.minimum(at, len(run) - 1)] == ids


def first_copies(ids: np.ndarray, order: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mask of the rows that are the lowest (order, row) of their id."""
    by = np.lexsort((row, order, ids))
    first = np.ones(len(ids), dtype=bool)
    first[1:] = ids[by][1:] != ids[by][:-1]
    out = np.zeros(len(ids), dtype=bool)
    out[by[first]] = True
    return out


def _arrays(run: str, part: int) -> list[np.ndarray]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    place, inner = opened(run)
    found = place.get_file_info(fs.FileSelector(f"{inner}/kind=novel/part={part}", allow_not_found=True))
    out = []
    for f in found:
        if f.path.endswith(".parquet"):
            t = pq.ParquetFile(place.open_input_file(f.path)).read(columns=["seq", "ids"]).sort_by("seq")
            out.append(np.frombuffer(b"".join(t.column("ids").to_pylist()), dtype="S16"))
    return out


def _blocks(ids: np.ndarray, source: str | None = None) -> list[list]:
    return [[source, None, i, ids[at : at + BLOCK_IDS].tobytes(), "novel"] for i, at in enumerate(range(0, len(ids), BLOCK_IDS))]


def _numbered(rows: DataFrame) -> DataFrame:
    """Without null row ids, which arrays can't hold beside exact numbers; ``surplus`` gives them back."""
    return rows.select("source", "h1", "h2", "ord", F.coalesce("row_id", F.lit(LAST)).alias("row_id"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which rows are surplus beside another one of the same block."""

    def marked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h1, h2, order, row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "ord", "row_id"))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(~first_copies(id_array(h1, h2), order, row))], names=[*b.schema.names, "surplus"])

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= BLOCK_ROWS:
            yield marked(held)
            held, n = [], 0
    if held:
        yield marked(held)


class IdentifierIndex:
    """Runs of sorted identifier arrays in a folder; give it batches in the order of their arrival."""

    def __init__(self, spark: SparkSession, root: str, bits: int, merge_at: int = 4, state: dict | None = None) -> None:
        """A new index of 2^bits prefixes; ``open`` goes on with one that is there."""
        self.spark, self.root, self.bits, self.merge_at = spark, root.rstrip("/"), bits, merge_at
        self.files = Files(spark, self.root)
        state = state or {"runs": [], "batches": 0, "merges": 0}
        self.runs, self.batches, self.merges = [f"{self.root}/{r}" for r in state["runs"]], state["batches"], state["merges"]

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> IdentifierIndex:
        text = Files(spark, root).read(f"{root.rstrip('/')}/manifest.json")
        if text is None:
            raise ValueError(f"no identifier index at {root}")
        state = json.loads(text)
        return cls(spark, root, state["bits"], state["merge_at"], state)

    def _commit(self) -> None:
        runs = [r.removeprefix(self.root + "/") for r in self.runs]
        self.files.replace(f"{self.root}/manifest.json", json.dumps({"bits": self.bits, "merge_at": self.merge_at, "runs": runs, "batches": self.batches, "merges": self.merges}))

    def part_of(self, h1: Column) -> Column:
        return F.shiftrightunsigned(h1, 64 - self.bits).cast("int") if self.bits else F.lit(0)

    def absorb(self, batch: DataFrame) -> None:
        """Split a batch (source, h1, h2, ord, row_id) into surplus copies and novel identifiers, and keep both."""
        at = f"{self.root}/local/batch={self.batches}"
        self.files.remove(at)
        _numbered(batch).mapInArrow(_local, LOCAL_SCHEMA).write.partitionBy("surplus").parquet(at)
        self._absorb(self.spark.read.schema(LOCAL_SCHEMA).parquet(at).filter("NOT surplus"))

    def absorb_in_turn(self, rows: DataFrame, batch: Column, batches: int) -> None:
        """The same for several batches, told by a column that is their number: rows are read and reduced once for all."""
        at = f"{self.root}/local/batch={self.batches}"
        self.files.remove(at)
        local = _numbered(rows).mapInArrow(_local, LOCAL_SCHEMA)
        local.withColumn("turn", batch).write.partitionBy("surplus", "turn").parquet(at)
        kept = self.spark.read.schema(f"{LOCAL_SCHEMA}, turn int").parquet(at).filter("NOT surplus")
        for i in range(batches):
            self._absorb(kept.filter(F.col("turn") == i))

    def _absorb(self, batch: DataFrame) -> None:
        runs = list(self.runs)

        def split(key, pdf):  # noqa: ANN001, ANN202
            import pandas as pd

            part = int(key[0])
            ids = id_array(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())
            known = reduce(np.logical_or, (known_in(ids, a) for r in runs for a in _arrays(r, part)), np.zeros(len(ids), dtype=bool))
            first = first_copies(ids, pdf["ord"].to_numpy(), pdf["row_id"].to_numpy()) & ~known
            spare = pdf.loc[~first, ["source", "row_id"]].assign(seq=0, ids=None, kind="surplus", part=-1)
            novel = pd.DataFrame(_blocks(np.sort(ids[first])), columns=["source", "row_id", "seq", "ids", "kind"]).assign(part=part)
            out = pd.concat([x for x in (spare, novel) if len(x)] or [spare])
            return out[["source", "row_id", "seq", "ids", "kind", "part"]].astype({"row_id": "Int64", "part": "int32", "seq": "int32"})

        rows = batch.select("source", "h1", "h2", "ord", "row_id", self.part_of(F.col("h1")).alias("part"))
        run = f"{self.root}/out/batch={self.batches}"
        self.files.remove(run)
        rows.groupBy("part").applyInPandas(split, "source string, row_id bigint, seq int, ids binary, kind string, part int").write.partitionBy("kind", "part").parquet(run)
        self.runs.append(run)
        self.batches += 1
        if len(self.runs) >= self.merge_at:
            self.merge()
        self._commit()

    def merge(self) -> None:
        """All runs become one, prefix by prefix."""
        runs = list(self.runs)

        def merged(batches):  # noqa: ANN001, ANN202
            import pandas as pd

            for b in batches:
                for part in b["id"]:
                    arrays = [a for r in runs for a in _arrays(r, int(part))]
                    if arrays:
                        rows = _blocks(np.sort(np.concatenate(arrays), kind="stable"))
                        yield pd.DataFrame(rows, columns=["source", "row_id", "seq", "ids", "kind"]).assign(part=int(part))[["seq", "ids", "kind", "part"]]

        n = 1 << self.bits
        to = f"{self.root}/merged/{self.merges}"
        self.files.remove(to)
        parts = self.spark.range(0, n, 1, min(n, max(8, self.spark.sparkContext.defaultParallelism)))
        parts.mapInPandas(merged, "seq int, ids binary, kind string, part int").write.partitionBy("kind", "part").parquet(to)
        self.runs, self.merges = [to], self.merges + 1

    def surplus(self) -> DataFrame:
        """The surplus copies of all batches so far."""
        if not self.batches:
            return self.spark.createDataFrame([], "source string, row_id bigint")
        looked_up = self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.root}/out").filter(f"kind = 'surplus' AND batch < {self.batches}")
        local = self.spark.read.schema(f"{LOCAL_SCHEMA}, batch int").option("basePath", f"{self.root}/local").parquet(f"{self.root}/local").filter(f"surplus AND batch < {self.batches}")
        return looked_up.select("source", "row_id").unionByName(local.select("source", "row_id")).select("source", F.nullif("row_id", F.lit(LAST)).alias("row_id"))


def surplus_copies(messages: DataFrame, batches: int = 4, merge_at: int = 3, rows_per_group: int = 500_000, index: str | None = None) -> DataFrame:
    """source, row_id of every surplus copy among messages (source, identifier, ord, row_id).

    identifier: any column; ord: a timestamp. The table is taken in ``batches`` ranges of ``ord``, as the
    messages arrived, each against the index that the ranges before it left. index: where the index is kept (by default in the session's
    intermediate data).
    """
    spark = messages.sparkSession
    order = F.coalesce(F.unix_micros(F.col("ord").cast("timestamp")), F.lit(LAST))
    rows = messages.filter("identifier IS NOT NULL").select(
        "source", F.xxhash64("source", "identifier").alias("h1"), F.xxhash64(F.lit("second"), "identifier", "source").alias("h2"), order.alias("ord"), F.col("row_id").cast("bigint").alias("row_id")
    )
    # ranges only set what a batch is, so rows without identifier may count
    n, bounds = messages.select(order.alias("ord")).agg(F.count("*"), F.percentile_approx("ord", [i / batches for i in range(1, batches)] or [0.5], 10_000)).first()
    if not n:
        return spark.createDataFrame([], "source string, row_id bigint")
    bits = max(3, int(np.ceil(np.log2(max(1, n / batches / rows_per_group)))))
    made = IdentifierIndex(spark, index or scratch(spark, "identifiers"), bits, merge_at)
    edges = sorted(set(bounds or []))[: batches - 1]
    turn = F.lit(0)
    for i, e in enumerate(edges, 1):
        turn = F.when(F.col("ord") > e, i).otherwise(turn)
    made.absorb_in_turn(rows, turn, len(edges) + 1)
    return made.surplus()
