"""Tables in a folder: immutable data folders and a manifest that names the current ones.

A write stages its data beside the current data and ends with one rename of the manifest. Readers see the state before or
after it, change log included, and a write that fails leaves only a folder that nobody names.

Nothing that stays is written again. An upsert adds the rows of the batch and, for the rows they replace, the positions (file
and row in it), which readers leave out; to find them only the key columns of the table are read, and of these only the files and row
groups whose range meets the batch's. A history adds the closed versions and the new ones: closed versions lie apart from the open
ones, so a snapshot reads open versions only, and each closed row carries the position of the open row that it ends.
Once the positions left out pass a quarter of the rows, the write compacts them away.

A batch is evaluated once, as it is staged; its checks read the staged key columns and the counts taken while writing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.changes import compute_changes
from weirflow.operators.merges import SYSTEM, opened, ordered, repeated_keys, versioned
from weirflow.plans.projection import Declared

FILE, ROW = "_wf_file", "_wf_row"
#: Positions left out up to which they go to all executors at once (some 100 bytes each); beyond, they are joined by shuffling.
HELD_POSITIONS = 1_000_000
#: Share of a table's rows that may be left out before it is compacted.
LOOSE = 0.25
LOG_SCHEMA = "id long, asset_name string, op string, pk string, before_data string, after_data string, run_id string, captured_at timestamp"


class Files:
    """The few file operations that tables need, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io, self._jvm = jvm.org.apache.commons.io.IOUtils, jvm

    def read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def swap(self, source: str, target: str) -> None:
        """Put a file in another's place in one step, where the file system can."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(self._path(source), self._path(target), options)

    def replace(self, path: str, text: str) -> None:
        """Write a small file as a whole: readers see the old or the new text."""
        staged = f"{path}-{uuid.uuid4().hex}"
        self.write(staged, text)
        self.swap(staged, path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


@dataclass
class Manifest:
    """What a table is now. data, closed: folders of rows (of a history: open and closed versions); gone: folders of positions that no longer count."""

    schema: str
    keys: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    data: list[str] = field(default_factory=list)
    closed: list[str] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    rows: int = 0
    gone_rows: int = 0
    logs: list[str] = field(default_factory=list)
    log_ends: list[int] = field(default_factory=list)
    next_id: int = 1
    version: int = 0


@dataclass
class Model:
    """How an asset is written; names and values as in its configuration."""

    materialization: str = "table"
    unique_key: list[str] = field(default_factory=list)
    incremental_strategy: str = "append"
    on_schema_change: str = "ignore"
    strategy: str | None = None
    updated_at: str | None = None
    check_cols: list[str] | str | None = None
    hard_deletes: str = "ignore"

    def __post_init__(self) -> None:
        if isinstance(self.unique_key, str):
            self.unique_key = [self.unique_key]
        self.unique_key = list(self.unique_key or [])
        for value, known, what in (
            (self.materialization, ("table", "incremental", "snapshot"), "materialization"),
            (self.incremental_strategy, ("append", "merge", "delete+insert"), "incremental_strategy"),
            (self.on_schema_change, ("ignore", "append_new_columns", "fail", "sync_all_columns"), "on_schema_change"),
            (self.hard_deletes, ("ignore", "invalidate", "new_record"), "hard_deletes"),
        ):
            if value not in known:
                raise ValueError(f"{what} must be one of {', '.join(known)}, not '{value}'")
        if self.materialization == "snapshot":
            self._check_snapshot()
        elif self.materialization == "incremental" and self.incremental_strategy != "append" and not self.unique_key:
            raise ValueError(f"incremental strategy '{self.incremental_strategy}' needs unique_key")

    def _check_snapshot(self) -> None:
        if not self.unique_key:
            raise ValueError("a snapshot needs unique_key")
        if self.strategy not in ("timestamp", "check"):
            raise ValueError("a snapshot needs strategy: timestamp or check")
        if self.strategy == "timestamp" and not self.updated_at:
            raise ValueError("snapshot strategy 'timestamp' needs updated_at")
        if self.strategy == "check" and not self.check_cols:
            raise ValueError("snapshot strategy 'check' needs check_cols")
        if self.check_cols is not None and self.check_cols != "all" and not isinstance(self.check_cols, list):
            raise ValueError("check_cols must be a list of columns or 'all'")
        if self.on_schema_change == "sync_all_columns":
            raise ValueError("sync_all_columns isn't allowed for snapshots")


@dataclass
class Drift:
    """Differences between a table and its declaration."""

    added: list[str]
    removed: list[str]
    retyped: list[str]
    keys: bool
    nullability: list[str]

    def __bool__(self) -> bool:
        return bool(self.added or self.removed or self.retyped or self.keys or self.nullability)


class Table:
    def __init__(self, spark: SparkSession, path: str, loose: float = LOOSE) -> None:
        self.spark, self.path, self.loose = spark, path.rstrip("/"), loose
        self.files = Files(spark, self.path)

    # --- state

    def manifest(self) -> Manifest | None:
        text = self.files.read(f"{self.path}/manifest.json")
        return Manifest(**json.loads(text)) if text else None

    def exists(self) -> bool:
        return self.manifest() is not None

    def _commit(self, m: Manifest) -> None:
        now = self.manifest()
        if (now.version if now else 0) != m.version:
            raise RuntimeError(f"{self.path} was written meanwhile; the batch is to be written again")
        m.version += 1
        self.files.replace(f"{self.path}/manifest.json", json.dumps(asdict(m)))

    def _folder(self, names: list[str], schema: Any = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*[f"{self.path}/{f}" for f in names])

    def _rows(self, m: Manifest, closed: bool = True, positions: bool = False) -> DataFrame:
        """The rows that count. closed: with the closed versions of a history; positions: with the file and row of each."""
        schema = T.StructType.fromJson(json.loads(m.schema))
        if not m.data and not (closed and m.closed):
            out = self.spark.createDataFrame([], schema)
            return out.withColumns({FILE: F.lit(""), ROW: F.lit(0).cast("long")}) if positions else out
        open_rows = self._folder(m.data, schema) if m.data else self.spark.createDataFrame([], schema)
        if positions or m.gone:
            open_rows = open_rows.withColumns({FILE: F.col("_metadata.file_name"), ROW: F.col("_metadata.row_index")}) if m.data else open_rows.withColumns({FILE: F.lit(""), ROW: F.lit(0).cast("long")})
        if m.gone:
            left_out = self._folder(m.gone, f"{FILE} string, {ROW} long").filter(F.col(FILE).isNotNull())
            open_rows = open_rows.join(F.broadcast(left_out) if m.gone_rows <= HELD_POSITIONS else left_out, [FILE, ROW], "left_anti")
            open_rows = open_rows if positions else open_rows.drop(FILE, ROW)
        if not closed or not m.closed:
            return open_rows.select(*[f"`{f.name}`" for f in schema.fields], *([FILE, ROW] if positions else []))
        return open_rows.select(*[f"`{f.name}`" for f in schema.fields]).unionByName(self._folder(m.closed, schema))

    def read(self) -> DataFrame:
        m = self.manifest()
        if m is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(m)

    def changes(self) -> DataFrame:
        """The change log."""
        m = self.manifest()
        if m is None or not m.logs:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*[f"{self.path}/{f}" for f in m.logs])

    def last_id(self) -> int:
        """The number of the latest change, 0 before the first."""
        m = self.manifest()
        return m.next_id - 1 if m else 0

    def pending(self, last_id: int, n: int) -> DataFrame:
        """The next n changes after an id. Numbers are dense, so only the log folders that hold them are read."""
        m = self.manifest()
        if m is None or n < 1:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        first = [0, *m.log_ends]
        wanted = [f for f, lo, hi in zip(m.logs, first, m.log_ends) if hi > last_id and lo < last_id + n]
        if not wanted:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self._folder(wanted, LOG_SCHEMA).filter(F.col("id").between(last_id + 1, last_id + n)).orderBy("id")

    # --- schema

    def drift(self, m: Manifest, batch: DataFrame, declared: list[Declared], snapshot: bool) -> Drift:
        have = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(m.schema)).fields if not (snapshot and f.name in SYSTEM)}
        want = {f.name: f.dataType for f in batch.schema.fields}
        keys = [] if snapshot else [d.name for d in declared if d.key]
        not_null = {d.name for d in declared if d.key or not d.nullable}
        return Drift(
            added=[n for n in want if n not in have],
            removed=[n for n in have if n not in want],
            retyped=[n for n in want if n in have and have[n] != want[n]],
            keys=bool(declared) and sorted(keys) != sorted(m.keys),
            nullability=[n for n in want if n in have and declared and (n in not_null) != (n in m.not_null)],
        )

    def _evolve(self, m: Manifest, batch: DataFrame, declared: list[Declared], model: Model) -> DataFrame:
        """Apply the policy; gives the batch as it fits the table."""
        snapshot = model.materialization == "snapshot"
        d = self.drift(m, batch, declared, snapshot)
        if not d:
            return batch
        if model.on_schema_change == "fail":
            raise ValueError(f"the schema changed: added {d.added}, removed {d.removed}, retyped {d.retyped}, keys {d.keys}, nullability {d.nullability}")
        old = T.StructType.fromJson(json.loads(m.schema))
        if model.on_schema_change == "ignore":
            kept = [f.name for f in old.fields if f.name in batch.columns]
            return batch.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in old.fields if f.name in kept])
        want = {f.name: f for f in batch.schema.fields}
        fields = list(old.fields)
        if model.on_schema_change == "sync_all_columns":
            if d.retyped:
                # rows are rewritten under their new types; columns are never dropped
                rows = self._rows(m).select(*[F.col(f"`{f.name}`").try_cast(want[f.name].dataType).alias(f.name) if f.name in d.retyped else F.col(f"`{f.name}`") for f in fields])
                fields = [T.StructField(f.name, want[f.name].dataType) if f.name in d.retyped else f for f in fields]
                name, n = self._stage(rows)
                self._replace(m, name, n)
            m.keys = [x.name for x in declared if x.key]
            m.not_null = [x.name for x in declared if x.key or not x.nullable]
        elif d.retyped:
            batch = batch.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in d.retyped else F.col(f"`{f.name}`") for f in old.fields if f.name in batch.columns], *[f"`{n}`" for n in d.added])
        at = len(fields) - len(SYSTEM) if snapshot else len(fields)
        m.schema = T.StructType([*fields[:at], *[T.StructField(n, want[n].dataType) for n in d.added], *fields[at:]]).json()
        return batch

    # --- writing

    def _stage(self, df: DataFrame, **counts: Column) -> tuple[str, int]:
        """Write df once; its folder and number of rows. counts: what else is counted while writing, kept in ``self.counted``."""
        name = f"data-{uuid.uuid4().hex}"
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("_wf_rows"), *[c.alias(n) for n, c in counts.items()]).write.parquet(f"{self.path}/{name}")
        self.counted = dict(seen.get)
        return name, self.counted["_wf_rows"]

    @staticmethod
    def _replace(m: Manifest, name: str, rows: int) -> None:
        m.data, m.closed, m.gone, m.rows, m.gone_rows = [name], [], [], rows, 0

    def _stage_batch(self, batch: DataFrame, not_null: list[str]) -> tuple[str, int]:
        """Stage a batch and refuse it if it has nulls where none may be."""
        nulls = [n for n in not_null if n in batch.columns]
        name, rows = self._stage(batch, **{f"_wf_null_{i}": F.count_if(F.col(f"`{n}`").isNull()) for i, n in enumerate(nulls)})
        if wrong := [n for i, n in enumerate(nulls) if self.counted[f"_wf_null_{i}"]]:
            self.files.remove(f"{self.path}/{name}")
            raise ValueError(f"nulls in {', '.join(wrong)} of {self.path}")
        return name, rows

    def _refuse_repeats(self, name: str, keys: list[str], what: str = "") -> None:
        """Refuse a staged batch with repeated keys; only its key columns are read."""
        if keys and repeated_keys(self._folder([name]).select(*[f"`{k}`" for k in keys]), keys).limit(1).count():
            self.files.remove(f"{self.path}/{name}")
            raise ValueError(f"repeated keys ({', '.join(keys)}) in {what}{self.path}")

    def _meeting(self, rows: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
        """rows within the span of the batch's first key, which the scan can use to leave out files and row groups."""
        k = f"`{keys[0]}`"
        if rows.schema[keys[0]].dataType != batch.schema[keys[0]].dataType or isinstance(rows.schema[keys[0]].dataType, (T.BinaryType, T.BooleanType, T.StructType, T.ArrayType, T.MapType)):
            return rows
        low, high = batch.agg(F.min(k), F.max(k)).first()
        return rows.filter(F.col(k).between(F.lit(low), F.lit(high))) if low is not None else rows.filter(F.lit(False))

    def _leave_out(self, m: Manifest, positions: DataFrame) -> None:
        name, n = self._stage(positions.select(FILE, ROW))
        if n:
            m.gone.append(name)
            m.gone_rows += n
        else:
            self.files.remove(f"{self.path}/{name}")

    def _last_of_repeats(self, name: str, keys: list[str], updated_at: str | None) -> DataFrame:
        """Positions of the rows of a staged batch that a later one of the same key replaces: by ``updated_at``, else in the order of the batch."""
        columns = [*keys, *([updated_at] if updated_at and updated_at not in keys else [])]
        rows = self._folder([name]).select(*[f"`{c}`" for c in columns], F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        order = [F.col(f"`{updated_at}`").desc_nulls_last()] if updated_at else []
        n = F.row_number().over(Window.partitionBy(*[f"`{k}`" for k in keys]).orderBy(*order, F.col(FILE).desc(), F.col(ROW).desc()))
        return rows.withColumn("_wf_n", n).filter("_wf_n > 1").select(FILE, ROW)

    def _compact(self, m: Manifest) -> None:
        """Write the rows that count anew once too many don't."""
        if m.gone and m.gone_rows > self.loose * max(1, m.rows):
            closed, m.closed = m.closed, []
            name, _ = self._stage(self._rows(m))
            m.data, m.closed, m.gone, m.rows, m.gone_rows = [name], closed, [], m.rows - m.gone_rows, 0

    def _log(self, m: Manifest, new: DataFrame, old: DataFrame | None, keys: list[str], asset: str, run_id: str, now: datetime) -> None:
        """Stage the changes with ids that go on from the last: dense within the write, in the order of the key."""
        events = compute_changes(new, old, keys)
        name = f"log-{uuid.uuid4().hex}"
        staged = f"{self.path}/{name}-raw"
        events.repartitionByRange("pk").sortWithinPartitions("pk").withColumns({"part": F.spark_partition_id(), "no": F.monotonically_increasing_id()}).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("no").alias("first")).orderBy("part").collect()  # a row per partition
        start, at = {}, m.next_id
        for p in parts:
            start[p["part"]] = at - p["first"]
            at += p["n"]
        if parts:
            offsets = F.create_map(*[F.lit(x) for p, s in start.items() for x in (p, s)])
            ident = F.col("no") + F.element_at(offsets, F.col("part"))
        else:
            ident = F.col("no")
        columns = [ident.cast("long").alias("id"), F.lit(asset).alias("asset_name"), "op", "pk", "before_data", "after_data", F.lit(run_id).alias("run_id"), F.lit(now).cast("timestamp").alias("captured_at")]
        rows.select(*columns).write.parquet(f"{self.path}/{name}")
        self.files.remove(staged)
        m.logs.append(name)
        m.log_ends.append(at - 1)
        m.next_id = at

    def materialize(self, batch: DataFrame, model: Model, declared: list[Declared] | None = None, *, now: datetime, asset: str = "", run_id: str = "", track: bool = False, insert_only: bool = False) -> dict[str, Any]:
        """Write a batch as the model says. Gives rows_loaded, table_created, schema_updated, materialization_type.

        track: the change log gets the differences between the states before and after; ``insert_only`` logs every row of
        the batch as an insert instead. Of repeated keys in a merge the last row by ``updated_at`` counts; without it the last
        of the batch, if the batch has an order (sorted, or as read from files), else they are refused.
        """
        declared = declared or []
        m = self.manifest()
        created = m is None
        snapshot = model.materialization == "snapshot"
        declared_keys = [d.name for d in declared if d.key]
        not_null = [d.name for d in declared if d.key or not d.nullable]
        before = None if created else self._rows(Manifest(**asdict(m)))
        schema_before = m.schema if m else ""
        if created:
            extra = opened(batch.limit(0), now).schema.fields[-len(SYSTEM) :] if snapshot else []
            m = Manifest(schema=T.StructType([T.StructField(f.name, f.dataType) for f in [*batch.schema.fields, *extra]]).json(), keys=[] if snapshot else declared_keys, not_null=not_null)
            schema_before = m.schema
        elif model.materialization == "table":
            m.schema, m.keys, m.not_null = T.StructType([T.StructField(f.name, f.dataType) for f in batch.schema.fields]).json(), declared_keys, not_null
        else:
            batch = self._evolve(m, batch, declared, model)
        target = T.StructType.fromJson(json.loads(m.schema))
        shown = batch.select(*[f"`{f.name}`" for f in target.fields if f.name in batch.columns])
        keys = model.unique_key
        has_order = ordered(shown)
        name, loaded = self._stage_batch(opened(shown, now) if created and snapshot else shown, m.not_null)
        staged = self.staged = self._folder([name])
        touched: tuple[DataFrame, DataFrame] | None = None
        if model.materialization == "table":
            self._refuse_repeats(name, m.keys)
            self._replace(m, name, loaded)
        elif snapshot:
            self._refuse_repeats(name, keys, "a snapshot of ")
            if created:
                self._replace(m, name, loaded)
            else:
                self._snapshot(m, staged, model, now)
        else:
            old = None if created else self._rows(m, positions=True)
            if created or model.incremental_strategy == "append":
                self._refuse_repeats(name, m.keys)
                if not created and m.keys:
                    clash = self._meeting(old.select(*m.keys), staged, m.keys).join(staged.select(*m.keys), m.keys, "left_semi")
                    if clash.limit(1).count():
                        self.files.remove(f"{self.path}/{name}")
                        raise ValueError(f"repeated keys ({', '.join(m.keys)}) in {self.path}")
            else:
                wanted = staged.select(*[f"`{k}`" for k in keys])
                if model.incremental_strategy == "merge" and repeated_keys(wanted, keys).limit(1).count():
                    if not model.updated_at and not has_order:
                        self.files.remove(f"{self.path}/{name}")
                        raise ValueError(f"repeated keys ({', '.join(keys)}) in a batch without order for {self.path}: sort it or give updated_at")
                    self._leave_out(m, self._last_of_repeats(name, keys, model.updated_at))
                hits = self._meeting(old, staged, keys).join(wanted.distinct(), keys, "left_semi")
                if track and not insert_only and sorted(declared_keys or batch.columns[:1]) == sorted(keys):
                    one = Manifest(m.schema, data=[name], gone=m.gone, gone_rows=m.gone_rows)
                    touched = (self._rows(one), hits.drop(FILE, ROW))
                self._leave_out(m, hits)
            m.data.append(name)
            m.rows += loaded
        if track:
            log_keys = declared_keys or batch.columns[:1]
            if insert_only:
                self._log(m, self._folder([name]).drop(*SYSTEM), None, log_keys, asset, run_id, now)
            elif touched:
                self._log(m, *touched, log_keys, asset, run_id, now)
            else:
                columns = [f.name for f in target.fields if f.name not in SYSTEM]
                live = self._rows(m, closed=False).select(*columns) if snapshot else self._rows(m)
                was = before.filter("is_current").drop(*SYSTEM) if before is not None and snapshot else before
                self._log(m, live, was, log_keys, asset, run_id, now)
        self._compact(m)
        self._commit(m)
        return {"rows_loaded": loaded, "table_created": created, "schema_updated": m.schema != schema_before, "materialization_type": model.materialization}

    def _snapshot(self, m: Manifest, batch: DataFrame, model: Model, now: datetime) -> None:
        """Add what a full batch closes and opens; versions that stay aren't touched."""
        open_rows = self._rows(m, closed=False, positions=True)
        changed = versioned(open_rows, batch, model.unique_key, now, model.strategy, model.updated_at, model.check_cols, model.hard_deletes, carry=[FILE, ROW])
        name = f"data-{uuid.uuid4().hex}"
        seen = Observation(name)
        counted = changed.observe(seen, F.count(F.lit(1)).alias("n"), F.count(FILE).alias("closed"))
        counted.withColumn("kind", F.when(F.col(FILE).isNull(), "open").otherwise("closed")).write.partitionBy("kind").parquet(f"{self.path}/{name}")
        n = seen.get
        if n["closed"]:
            m.closed.append(f"{name}/kind=closed")
            m.gone.append(f"{name}/kind=closed")
            m.gone_rows += n["closed"]
        if n["n"] > n["closed"]:
            m.data.append(f"{name}/kind=open")
        m.rows += n["n"]

    def vacuum(self) -> int:
        """Remove data and log folders that the manifest doesn't name (left by failed or past writes)."""
        m = self.manifest()
        named = {f.split("/")[0] for f in [*m.data, *m.closed, *m.gone, *m.logs]}
        gone = 0
        for s in self.files._fs.listStatus(self.files._path(self.path)):
            name = s.getPath().getName()
            if name not in named and name != "manifest.json" and name.split("-")[0] in ("data", "log", "manifest"):
                self.files.remove(f"{self.path}/{name}")
                gone += 1
        return gone


class TableStore:
    """Tables by two-part name below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> Table:
        parts = name.split(".")
        if not all(p.replace("_", "").isalnum() for p in parts):
            raise ValueError(f"odd table name '{name}'")
        return Table(self.spark, "/".join([self.root, *parts]))
