"""Sources that aren't files: HTTP APIs and event queues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weirflow.registry import connections
from weirflow.sources.inference import to_frame


@connections.register("api")
@dataclass
class Api:
    """An HTTP API below a base address."""

    base_url: str
    timeout: float = 30
    headers: dict[str, str] = field(default_factory=dict)
    send: Callable[..., Any] | None = None  # as requests.request; for tests

    def request(self, method: str, endpoint: str, **kwargs: Any) -> Any:
        send = self.send
        if send is None:
            import requests

            send = requests.request
        return send(method, self.base_url.rstrip("/") + "/" + endpoint.lstrip("/"), headers=self.headers or None, timeout=self.timeout, **kwargs)

    def rows(self, spark: SparkSession, endpoint: str, method: str = "GET", **kwargs: Any) -> DataFrame:
        if method.upper() not in ("GET", "POST"):
            raise ValueError(f"an API asset is read by GET or POST, not {method}")
        r = self.request(method.upper(), endpoint, **kwargs)
        r.raise_for_status()
        return to_frame(spark, r.json())

    def healthy(self, endpoint: str, method: str = "GET") -> bool:
        if method.upper() not in ("GET", "POST", "HEAD"):
            raise ValueError(f"no health check by {method}")
        try:
            return bool(self.request(method.upper(), endpoint).ok)
        except Exception:  # noqa: BLE001 - unreachable is not healthy
            return False


connections.register("http")(Api)


def event_rows(spark: SparkSession, queue: Any, event_type: str | None = None) -> DataFrame:
    """What a queue's ``consume(event_type=...)`` gives; nothing gives an empty frame."""
    found = queue.consume(event_type=event_type)
    return to_frame(spark, found) if found else spark.createDataFrame([], T.StructType([]))


def event_stream(spark: SparkSession, folder: str, schema: str, event_type: str | None = None) -> DataFrame:
    """A stream of events from a folder of JSON lines; other transports plug in by their own format of readStream."""
    events = spark.readStream.schema(schema).json(folder)
    return events.filter(events["event_type"] == event_type) if event_type else events
