"""Running a pipeline: one lazy plan per asset, then one write with its change log, then its checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weirflow.operators.quality import Result, implied, validate
from weirflow.operators.tables import Model, TableStore
from weirflow.plans.flow import lineage
from weirflow.plans.projection import Declared, Run, project
from weirflow.plans.spec import Asset, Pipeline
from weirflow.registry import connections, sources
from weirflow.sources import connections as _connections  # noqa: F401 - registers the kinds
from weirflow.sources.feeds import event_rows
from weirflow.sources.files import read_file
from weirflow.sources.templates import render


class CheckFailed(ValueError):
    def __init__(self, asset: str, failed: list[Result]) -> None:
        super().__init__(f"{asset}: {', '.join(r.name for r in failed)} failed")
        self.failed = failed


@dataclass
class Done:
    """What became of an asset."""

    data: DataFrame
    written: dict[str, Any] | None = None
    checks: list[Result] = field(default_factory=list)
    lineage: dict[str, dict[str, list[str]]] = field(default_factory=dict)


class Runner:
    """Runs the assets of a pipeline. connections: by resource name, for what the configuration can't build itself."""

    def __init__(self, spark: SparkSession, pipeline: Pipeline, store: TableStore, connections: dict[str, Any] | None = None) -> None:
        self.spark, self.pipeline, self.store = spark, pipeline, store
        self.connections = dict(connections or {})

    def connection(self, name: str) -> Any:
        if name not in self.connections:
            r = self.pipeline.resources.get(name)
            if r is None:
                raise ValueError(f"no resource '{name}'")
            if r.type not in connections:
                raise ValueError(f"resource '{name}' of type '{r.type}' must be given to the runner")
            make = connections.get(r.type)
            known = getattr(make, "__dataclass_fields__", None)
            self.connections[name] = make(**{k: v for k, v in r.config.items() if known is None or k in known})
        return self.connections[name]

    def _upstream(self, asset: Asset, needs: list[str], have: dict[str, DataFrame]) -> list[tuple[str, DataFrame]]:
        return [(n, have[n]) for n in needs if n in have]

    def _source(self, asset: Asset, run: Run, inputs: list[tuple[str, DataFrame]]) -> DataFrame:
        s = asset.source
        if asset.type == "api":
            df = self.connection(s.get("resource", "api_resource")).rows(self.spark, s["endpoint"], s.get("method", "GET"))
        elif asset.type == "file":
            path = run.partition_key or s.get("path") or s.get("file_path")
            if not path:
                raise ValueError(f"asset '{asset.name}' needs a path: its partition key is the file")
            df = read_file(self.spark, render(path), self.pipeline.formats[asset.file_format] if asset.file_format else None)
        elif asset.type == "event":
            df = event_rows(self.spark, self.connection(s["resource"]), s.get("event_type"))
        elif asset.type == "computed":
            if not inputs:
                raise ValueError(f"asset '{asset.name}' has no upstream")
            return inputs[0][1]
        elif asset.type == "dbt":
            if "sql" not in s:
                raise ValueError(f"asset '{asset.name}': give the model's query as source.sql")
            return self.spark.sql(s["sql"], **dict(inputs))
        elif asset.type in sources:
            df = sources.get(asset.type)(self.spark, asset, run)
        else:
            raise ValueError(f"no source of type '{asset.type}'")
        return df

    def _database(self, asset: Asset, run: Run, inputs: list[tuple[str, DataFrame]]) -> Done:
        """Each upstream is projected by the same columns; the results are one table."""
        if not inputs:
            raise ValueError(f"asset '{asset.name}' has no upstream")
        columns = asset.columns or [Declared(c) for c in inputs[0][1].columns]
        parts = [(n, df, project(df, columns, asset.pre, asset.post, run)) for n, df in inputs]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.data for _, _, p in parts])
        traced = lineage(parts[0][2].lineage, {n: df.columns for n, df, _ in parts})
        table = self.store.table(asset.source.get("table", asset.name))
        written = table.materialize(out, asset.model or Model(), columns, now=run.at, asset=asset.name, run_id=run.run_id, track=asset.change_tracking)
        # the batch is checked and handed on as it was staged, so it isn't computed again
        staged = table.staged if set(out.columns) <= set(table.staged.columns) else out
        data = staged.select(*[f"`{c}`" for c in out.columns])
        return Done(data, written, validate(data, [*implied(columns), *asset.checks], columns), traced)

    def materialize(self, name: str, have: dict[str, DataFrame], needs: list[str], run: Run) -> Done:
        asset = self.pipeline.assets[name]
        run = Run(run.run_id, run.tags, name, run.partition_key, run.at)
        inputs = self._upstream(asset, needs, have)
        if asset.type == "database":
            return self._database(asset, run, inputs)
        df = self._source(asset, run, inputs)
        wanted = [c for c in implied(asset.columns) if c.column in df.columns] + asset.checks
        return Done(df, None, validate(df, wanted, asset.columns) if wanted else [])

    def run_job(self, job: str, partition_key: str | None = None, tags: dict[str, str] | None = None, run_id: str | None = None, on_done: Callable[[str, Done], None] | None = None) -> dict[str, Done]:
        """All assets of a job, upstreams first. A failed check of severity ERROR stops what lies behind."""
        flow = self.pipeline.flow(job)
        run = Run(run_id or uuid.uuid4().hex, tags or {}, "", partition_key)
        done: dict[str, Done] = {}
        have: dict[str, DataFrame] = {}
        for name in flow.order():
            try:
                done[name] = self.materialize(name, have, flow.upstream[name], run)
            except Exception:
                # where any of several upstreams will do, one that can't be read is left out
                below = [n for n, ups in flow.upstream.items() if name in ups]
                if below and all(n in flow.optional for n in below):
                    continue
                raise
            if failed := [r for r in done[name].checks if r.blocking]:
                raise CheckFailed(name, failed)
            have[name] = done[name].data
            if on_done:
                on_done(name, done[name])
        return done
