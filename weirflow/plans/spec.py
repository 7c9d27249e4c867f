"""Pipeline configurations: YAML files of a folder, read, merged, checked."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from weirflow.operators.quality import Check
from weirflow.operators.tables import Model
from weirflow.plans.flow import Flow, combine, parse_flow
from weirflow.plans.projection import Declared
from weirflow.registry import rules, sources, triggers
from weirflow.sources.files import Format
from weirflow.sources.templates import substitute

ASSET_TYPES = ("api", "database", "file", "computed", "dbt", "event")
TRIGGER_TYPES = ("polling", "api_polling", "schedule", "event", "asset_update", "file_drop", "cdc")
SECTIONS = ("resources", "file_formatters", "assets", "jobs", "sensors")


@dataclass
class Stream:
    type: str
    relay_endpoint: str
    config: dict[str, Any] = field(default_factory=dict)


@dataclass
class Asset:
    name: str
    type: str
    source: dict[str, Any] = field(default_factory=dict)
    columns: list[Declared] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    model: Model | None = None
    pre: str | None = None
    post: str | None = None
    depends_on: list[str] = field(default_factory=list)
    file_format: str | None = None
    partition_name: str | None = None
    change_tracking: bool = False
    streams: list[Stream] = field(default_factory=list)
    group_name: str = "default"
    description: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.type not in ASSET_TYPES and self.type not in sources:
            raise ValueError(f"asset '{self.name}': unknown type '{self.type}'")
        if self.model and self.type != "database":
            raise ValueError(f"asset '{self.name}': 'model' is for database assets only")
        if self.change_tracking and self.type != "database":
            raise ValueError(f"asset '{self.name}': change_tracking is for database assets only")
        if self.change_tracking and not self.streams:
            raise ValueError(f"asset '{self.name}': change_tracking needs a stream")
        if self.streams and not self.change_tracking:
            raise ValueError(f"asset '{self.name}': streams need change_tracking")
        if self.type == "computed" and not self.depends_on:
            raise ValueError(f"asset '{self.name}': a computed asset needs depends_on")


@dataclass
class Job:
    name: str
    flow: Flow
    description: str | None = None


@dataclass
class Sensor:
    name: str
    type: str
    target: str | None = None
    interval: float = 30
    cron: str | None = None
    running: bool = True
    partition_name: str | None = None
    config: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.type not in TRIGGER_TYPES and self.type not in triggers:
            raise ValueError(f"sensor '{self.name}': unknown type '{self.type}'")
        if self.type == "schedule" and not self.cron:
            raise ValueError(f"sensor '{self.name}': a schedule needs cron")


@dataclass
class Resource:
    name: str
    type: str
    config: dict[str, Any] = field(default_factory=dict)


@dataclass
class Pipeline:
    assets: dict[str, Asset] = field(default_factory=dict)
    jobs: dict[str, Job] = field(default_factory=dict)
    sensors: dict[str, Sensor] = field(default_factory=dict)
    formats: dict[str, Format] = field(default_factory=dict)
    resources: dict[str, Resource] = field(default_factory=dict)

    def flow(self, *jobs: str) -> Flow:
        """The flow of some jobs (default: all), with what assets name as their upstreams."""
        names = jobs or tuple(self.jobs)
        out = combine([self.jobs[j].flow for j in names])
        for a in self.assets.values():
            if a.depends_on and (not jobs or a.name in out.upstream):
                out.add(a.name, *a.depends_on)
        return out


def _check(owner: str, column: str | None, raw: Any) -> Check:
    if isinstance(raw, str):
        name, body = raw, {}
    elif isinstance(raw, dict) and len(raw) == 1:
        name, body = next(iter(raw.items()))
        body = body or {}
    else:
        raise ValueError(f"{owner}: a test is a name, or a name with its settings")
    if name not in rules:
        raise ValueError(f"{owner}: unknown rule '{name}'; known: {', '.join(rules)}")
    return Check(name, column, str(body.get("severity") or "ERROR").upper(), dict(body.get("arguments") or {}))


def _asset(raw: dict[str, Any]) -> Asset:
    name = raw["name"]
    columns, found = [], []
    for c in raw.get("columns") or []:
        columns.append(Declared(c["name"], c.get("dtype"), c.get("expr"), c.get("nullable", True), c.get("unique", False), c.get("isKey", c.get("is_key", False))))
        found += [_check(name, c["name"], t) for t in c.get("tests") or []]
    found += [_check(name, None, t) for t in raw.get("tests") or []]
    chains = raw.get("transforms") or {}
    model = {k: v for k, v in (raw.get("model") or {}).items() if k in Model.__dataclass_fields__ and v is not None}
    plain = {k: raw[k] for k in ("depends_on", "file_format", "partition_name", "change_tracking", "group_name", "description", "tags", "metadata", "source") if raw.get(k) is not None}
    return Asset(name, raw["type"], columns=columns, checks=found, model=Model(**model) if raw.get("model") else None, pre=chains.get("pre"), post=chains.get("post"), streams=[Stream(s["type"], s["relay_endpoint"], s.get("config") or {}) for s in raw.get("streams") or []], **plain)


def _sensor(raw: dict[str, Any]) -> Sensor:
    t = raw.get("trigger") or {}
    return Sensor(raw["name"], raw["type"], t.get("target"), t.get("minimum_interval_seconds") or 30, t.get("cron") or (raw.get("config") or {}).get("cron"), str(t.get("default_status") or "RUNNING").upper() == "RUNNING", raw.get("partition_name"), raw.get("config") or {})


def build(sections: dict[str, list[dict]]) -> Pipeline:
    p = Pipeline()
    for raw in sections.get("resources") or []:
        p.resources[raw["name"]] = Resource(raw["name"], raw["type"], raw.get("config") or {})
    for raw in sections.get("file_formatters") or []:
        p.formats[raw["name"]] = Format(raw["name"], raw["type"], raw.get("config") or {}, raw.get("description"))
    for raw in sections.get("assets") or []:
        p.assets[raw["name"]] = _asset(raw)
    for raw in sections.get("jobs") or []:
        flow = raw["flow"] if isinstance(raw["flow"], str) else raw["flow"]["definition"]
        p.jobs[raw["name"]] = Job(raw["name"], parse_flow(flow), raw.get("description"))
    for raw in sections.get("sensors") or []:
        p.sensors[raw["name"]] = _sensor(raw)
    for a in p.assets.values():
        if a.file_format and a.file_format not in p.formats:
            raise ValueError(f"asset '{a.name}': unknown file format '{a.file_format}'")
        if missing := [d for d in a.depends_on if d not in p.assets]:
            raise ValueError(f"asset '{a.name}' depends on unknown {', '.join(missing)}")
    for j in p.jobs.values():
        if missing := [n for n in j.flow.upstream if n not in p.assets]:
            raise ValueError(f"job '{j.name}' names unknown assets {', '.join(missing)}")
    for s in p.sensors.values():
        if s.target and s.target not in p.jobs and s.target not in p.assets:
            raise ValueError(f"sensor '{s.name}' has unknown target '{s.target}'")
    p.flow().order()
    return p


def load(folder: str, suffixes: tuple[str, ...] = (".resource", ".macro", ".yaml", ".yml"), variables: dict[str, str] | None = None) -> Pipeline:
    """All files of a folder (not of its subfolders) by name, as one pipeline. A name may come once per section."""
    merged: dict[str, list[dict]] = {s: [] for s in SECTIONS}
    for path in sorted(Path(folder).iterdir(), key=lambda p: (suffixes.index(p.suffix) if p.suffix in suffixes else 99, p.name)):
        if path.suffix not in suffixes:
            continue
        try:
            raw = substitute(yaml.safe_load(path.read_text()) or {}, variables)
        except yaml.YAMLError as e:
            raise ValueError(f"{path.name}: {e}") from e
        for s in SECTIONS:
            for item in raw.get(s) or []:
                if any(x["name"] == item["name"] for x in merged[s]):
                    raise ValueError(f"{path.name}: '{item['name']}' comes twice in {s}")
                merged[s].append(item)
    return build(merged)
