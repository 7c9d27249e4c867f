"""Change logs as streams, and what takes them: HTTP, WebSocket, Kafka, or any registered sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.tables import LOG_SCHEMA, Table
from weirflow.plans.spec import Stream
from weirflow.registry import sinks

#: Events in a part of the log, of which a drain holds one at a time.
HELD_EVENTS = 25_000


def envelope(topic: str, events: list[dict[str, Any]], sensor: str = "", tags: dict[str, str] | None = None) -> dict[str, Any]:
    return {"topic": topic, "source": "cdc", "sensor": sensor, "tags": tags or {}, "count": len(events), "events": events}


@sinks.register("http")
def http_sink(stream: Stream, send: Callable[..., Any] | None = None) -> Callable[[dict], None]:
    """POST per envelope, five seconds at most; an error stops the batch, which is then delivered again."""
    def put(message: dict) -> None:
        post = send
        if post is None:
            import requests

            post = requests.post
        post(stream.relay_endpoint, json={"topic": message["topic"], "data": message}, timeout=5).raise_for_status()

    return put


@sinks.register("websocket")
def websocket_sink(stream: Stream, connect: Callable[..., Any] | None = None) -> Callable[[dict], None]:
    """One connection per batch, events as a JSON array."""
    def put(message: dict) -> None:
        opener = connect
        if opener is None:
            try:
                from websockets.sync.client import connect as opener
            except ImportError as e:
                raise RuntimeError("the websocket sink needs the package 'websockets'") from e
        with opener(stream.relay_endpoint) as ws:
            ws.send(json.dumps(message["events"], default=str))

    return put


def kafka_options(stream: Stream) -> dict[str, str]:
    server = stream.relay_endpoint.removeprefix("kafka://").split("/")[0]
    own = {k: v for k, v in stream.config.items() if k not in ("batch_size", "poll_interval_seconds", "topic")}
    return {"kafka.bootstrap.servers": server, **{f"kafka.{k}": str(v) for k, v in own.items()}}


def write_kafka(log: DataFrame, stream: Stream, topic: str, form: str = "kafka") -> None:
    """A frame of change events to a topic, from the executors; needs Spark's Kafka connector on the class path."""
    rows = log.select(F.col("pk").alias("key"), F.to_json(F.struct(*[c for c in log.columns if c != "file_name"])).alias("value"))
    rows.write.format(form).options(**kafka_options(stream)).option("topic", topic).save()


class LogStream:
    """Sends a table's change log through a stream: every tick delivers all log files that came since, from the executors, at least once.

    The stream's checkpoint lies in the table's folder, so the position outlives the process.
    """

    def __init__(self, spark: SparkSession, table: Table, asset: str, stream: Stream, write: Callable[[DataFrame, Stream, str], None] = write_kafka) -> None:
        self.spark, self.table, self.stream, self.write = spark, table, stream, write
        self.topic = stream.config.get("topic") or f"cdc.{asset}"
        self.checkpoint = f"{table.path}/cursor-{stream.type}-{abs(hash_text(stream.relay_endpoint)):x}"

    def tick(self) -> int:
        """The number of events sent."""
        m = self.table.manifest()
        if m is None or not m.logs:
            return 0
        sent: list[int] = []

        def deliver(df: DataFrame, _: int) -> None:
            df = df.persist()
            sent.append(df.count())
            self.write(df, self.stream, self.topic)
            df.unpersist()

        dispatch_stream(log_stream(self.spark, self.table), deliver, self.checkpoint).awaitTermination()
        return sum(sent)


def dispatcher(spark: SparkSession, table: Table, asset: str, stream: Stream) -> Dispatcher | LogStream:
    """What delivers a stream: Spark itself to Kafka, batches from the driver to all other sinks; an unknown kind is an error."""
    return LogStream(spark, table, asset, stream) if stream.type == "kafka" else Dispatcher(table, asset, stream)


class Dispatcher:
    """Sends the pending changes of a table to a sink in batches, each once its predecessor was taken.

    The position is kept in the table's folder after a batch is taken, so a batch may come twice after a crash but none is lost; receivers
    drop repeats by id.
    """

    def __init__(self, table: Table, asset: str, stream: Stream, put: Callable[[dict], None] | None = None, batch_size: int | None = None) -> None:
        self.table, self.asset, self.topic = table, asset, f"cdc.{asset}"
        self.batch_size = batch_size or int(stream.config.get("batch_size", 100))
        self.put = put or sinks.get(stream.type)(stream)
        self.cursor = f"{table.path}/cursor-{stream.type}-{abs(hash_text(stream.relay_endpoint)):x}.json"

    def position(self) -> int:
        text = self.table.files.read(self.cursor)
        return json.loads(text)["last_id"] if text else 0

    def _send(self, rows: Iterable[Row]) -> int:
        """Rows in the order of their numbers, batch by batch; the number of events sent."""
        total, rows = 0, iter(rows)
        while batch := list(islice(rows, self.batch_size)):
            self.put(envelope(self.topic, [{**r.asDict(), "captured_at": r["captured_at"].isoformat()} for r in batch]))
            self.table.files.write(self.cursor, json.dumps({"last_id": batch[-1]["id"]}))
            total += len(batch)
        return total

    def tick(self) -> int:
        """One batch; the number of events sent."""
        return self._send(self.table.pending(self.position(), self.batch_size).collect())  # at most batch_size rows

    def drain(self) -> int:
        """All that is pending, in the batches of ticks; the log is read and sorted once, and comes to the driver part by part."""
        total, n = 0, 1
        while n and (left := self.table.last_id() - (at := self.position())) > 0:
            parts = -(-left // HELD_EVENTS)
            n = self._send(self.table.pending(at, left).repartitionByRange(parts, "id").sortWithinPartitions("id").toLocalIterator())
            total += n
        return total


def hash_text(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def log_stream(spark: SparkSession, table: Table, max_files: int = 100) -> DataFrame:
    """A table's change log as a stream (its log folders are append-only)."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{table.path}/log-*")


def dispatch_stream(stream: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):  # noqa: ANN201
    """Micro-batches of a change stream to a function, at least once; the checkpoint holds the position."""
    writer = stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
