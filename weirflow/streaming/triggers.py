"""What starts jobs: intervals, cron, healthy APIs, new files, changes, finished assets.

A trigger answers one tick with the runs it asks for, or a reason for none; ``Service`` ticks all triggers that are due.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import Any

from weirflow.operators.tables import Files
from weirflow.plans.pipeline import Runner
from weirflow.plans.spec import Sensor
from weirflow.registry import triggers
from weirflow.sources.discovery import Cursor, local_files, object_files
from weirflow.streaming.dispatch import Dispatcher, LogStream, dispatcher


@dataclass
class Request:
    """A run that a trigger asks for. key: runs of one key are made once."""

    target: str
    key: str | None = None
    partition_key: str | None = None
    tags: dict[str, str] = field(default_factory=dict)


@dataclass
class Tick:
    requests: list[Request] = field(default_factory=list)
    skipped: str | None = None


class Cron:
    """Five fields: minute, hour, day, month, weekday (0 is Sunday); lists, ranges and steps."""

    SPANS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))

    def __init__(self, text: str) -> None:
        parts = text.split()
        if len(parts) != 5:
            raise ValueError(f"a cron expression has five fields: {text!r}")
        self.sets = [self._field(p, lo, hi) for p, (lo, hi) in zip(parts, self.SPANS)]
        if 7 in self.sets[4]:
            self.sets[4].add(0)
        self.any_day, self.any_weekday = parts[2] == "*", parts[4] == "*"

    @staticmethod
    def _field(text: str, lo: int, hi: int) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            body, _, step = part.partition("/")
            a, _, b = body.partition("-")
            first, last = (lo, hi) if body == "*" else (int(a), int(b or (hi if step else a)))
            if not lo <= first <= last <= hi:
                raise ValueError(f"cron field out of range: {part!r}")
            out |= set(range(first, last + 1, int(step or 1)))
        return out

    def on_day(self, t: datetime) -> bool:
        _, _, day, month, weekday = self.sets
        on_day, on_weekday = t.day in day, t.isoweekday() % 7 in weekday
        return t.month in month and (on_day and on_weekday if self.any_day or self.any_weekday else on_day or on_weekday)

    def matches(self, t: datetime) -> bool:
        return t.minute in self.sets[0] and t.hour in self.sets[1] and self.on_day(t)

    def after(self, t: datetime) -> datetime:
        """The first moment behind t: day by day, and within the first day that fits by its hours and minutes."""
        t = t.replace(second=0, microsecond=0) + timedelta(minutes=1)
        midnight = t.replace(hour=0, minute=0)
        for days in range(366 * 5):
            day = midnight + timedelta(days=days)
            if self.on_day(day):
                found = next((m for h in sorted(self.sets[1]) for k in sorted(self.sets[0]) if (m := day.replace(hour=h, minute=k)) >= t), None)
                if found:
                    return found
        raise ValueError("the cron expression never comes")


class Trigger:
    def __init__(self, sensor: Sensor, runner: Runner) -> None:
        self.sensor, self.runner = sensor, runner
        self.due = 0.0

    def tick(self) -> Tick:
        raise NotImplementedError

    def next_due(self, now: float) -> float:
        return now + self.sensor.interval

    def done(self) -> None:
        """Called once all that the last tick asked for was run."""

    def keeper(self) -> Callable[..., str | None]:
        """Where the trigger's state outlives the process: a file of the table store."""
        at = f"{self.runner.store.root}/_state/{self.sensor.type}-{self.sensor.name}.json"
        files = Files(self.runner.spark, self.runner.store.root)
        return lambda *text: files.replace(at, text[0]) if text else files.read(at)

    def _run(self, **kwargs: Any) -> Request:
        return Request(self.sensor.target, tags={"sensor": self.sensor.name}, **kwargs)


@triggers.register("polling")
class Polling(Trigger):
    def tick(self) -> Tick:
        return Tick([self._run()])


@triggers.register("schedule")
class Schedule(Trigger):
    def __init__(self, sensor: Sensor, runner: Runner) -> None:
        super().__init__(sensor, runner)
        self.cron = Cron(sensor.cron)
        self.due = self.next_due(time.time())

    def tick(self) -> Tick:
        return Tick([self._run()])

    def next_due(self, now: float) -> float:
        return self.cron.after(datetime.fromtimestamp(now, timezone.utc)).timestamp()


@triggers.register("api_polling")
class ApiPolling(Trigger):
    def tick(self) -> Tick:
        c = self.sensor.config
        if self.runner.connection(c.get("resource", "api_resource")).healthy(c["endpoint"], c.get("method", "GET")):
            return Tick([self._run()])
        return Tick(skipped=f"{c['endpoint']} isn't healthy")


@triggers.register("file_drop")
class FileDrop(Trigger):
    """One run per new or changed file, whose path is the partition. Files that were run are known after a restart."""

    def __init__(self, sensor: Sensor, runner: Runner, keep: Callable[[str], bool] | None = None) -> None:
        super().__init__(sensor, runner)
        self.cursor, self.keep = Cursor(keep=self.keeper()), keep

    def found(self) -> list[tuple[str, dict[str, Any]]]:
        c = self.sensor.config
        if c.get("source") == "s3":
            return object_files(self.runner.connection(c["resource"]), c["bucket"], c.get("prefix", ""), c.get("file_pattern", "*"), self.keep)
        return local_files(c["file_path"], c.get("file_pattern", "*"), (c.get("tracking") or {}).get("strategy", "mtime"), self.keep)

    def tick(self) -> Tick:
        fresh = self.cursor.fresh(self.found())
        if not fresh:
            return Tick(skipped="no new file")
        return Tick([self._run(partition_key=p, key=f"{p}@{sorted(self.cursor.seen[p].items())}") for p in fresh])

    def done(self) -> None:
        self.cursor.commit()


@triggers.register("cdc")
class Changes(Trigger):
    """Sends pending changes; asks for no run."""

    def __init__(self, sensor: Sensor, runner: Runner, dispatcher: Dispatcher | LogStream | None = None) -> None:
        super().__init__(sensor, runner)
        self.dispatcher = dispatcher

    def tick(self) -> Tick:
        n = self.dispatcher.tick()
        return Tick(skipped=f"{n} events sent" if n else "no change")


@triggers.register("event")
class Finished(Trigger):
    """A run after each write of the watched asset. The version that was run for is known after a restart."""

    def __init__(self, sensor: Sensor, runner: Runner) -> None:
        super().__init__(sensor, runner)
        self.keep = self.keeper()
        self.seen = int(self.keep() or 0)

    def done(self) -> None:
        self.keep(str(self.seen))

    def _version(self) -> int:
        name = self.sensor.config.get("asset") or self.sensor.config.get("upstream")
        asset = self.runner.pipeline.assets[name]
        m = self.runner.store.table(asset.source.get("table", name)).manifest()
        return m.version if m else 0

    def tick(self) -> Tick:
        now = self._version()
        if now == self.seen:
            return Tick(skipped="nothing was written")
        self.seen = now
        return Tick([self._run()])


@triggers.register("asset_update")
class Observed(Finished):
    """Watches an asset; never asks for a run."""

    def tick(self) -> Tick:
        return Tick(skipped=f"version {self._version()}")


class Service:
    """Ticks the running triggers of a pipeline and runs what they ask for."""

    def __init__(self, runner: Runner) -> None:
        self.runner = runner
        self.triggers: list[Trigger] = []
        for s in runner.pipeline.sensors.values():
            if s.running and s.type != "cdc":
                self.triggers.append(triggers.get(s.type)(s, runner))
        for a in runner.pipeline.assets.values():
            for st in a.streams:
                table = runner.store.table(a.source.get("table", a.name))
                sensor = Sensor(f"cdc_{a.name}_{st.type}", "cdc", interval=st.config.get("poll_interval_seconds", 10))
                self.triggers.append(Changes(sensor, runner, dispatcher(runner.spark, table, a.name, st)))
        self.made: set[str] = set()

    def step(self, now: float | None = None) -> list[tuple[str, Tick]]:
        """One round over the triggers that are due."""
        now = time.time() if now is None else now
        out = []
        for t in self.triggers:
            if t.due > now:
                continue
            tick = t.tick()
            t.due = t.next_due(now)
            out.append((t.sensor.name, tick))
            for r in tick.requests:
                if r.key is None or r.key not in self.made:
                    self.runner.run_job(r.target, r.partition_key, r.tags)
                    if r.key:
                        self.made.add(r.key)
            if tick.requests:
                t.done()
        return out
