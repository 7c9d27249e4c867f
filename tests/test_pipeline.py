import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F
from weirflow.operators.tables import Model, TableStore
from weirflow.plans.pipeline import CheckFailed, Runner
from weirflow.plans.spec import Stream, build, load
from weirflow.streaming.dispatch import Dispatcher, LogStream, dispatch_stream, dispatcher, envelope, http_sink, kafka_options, log_stream, websocket_sink
from weirflow.streaming.ingest import deduplicated, file_stream, ingest, sessions, tumbling
from weirflow.streaming.triggers import Cron, Service

CONFIG = """
resources:
  - {name: api_resource, type: api, config: {base_url: "${BASE:-http://h}"}}
file_formatters:
  - {name: pipes, type: csv, config: {delimiter: "|", null_if: ["", "NULL"]}}
assets:
  - name: orders_api
    type: api
    source: {endpoint: /orders}
    columns:
      - {name: order_id, dtype: string, nullable: false}
      - name: qty
        dtype: float
        tests:
          - expect_column_values_to_be_between: {arguments: {min: 0}, severity: WARN}
    tests: [expect_table_rows_to_be_unique]
  - name: orders_file
    type: file
    partition_name: files
    file_format: pipes
  - name: orders
    type: database
    depends_on: [orders_api, orders_file]
    source: {table: demo.orders}
    change_tracking: true
    streams:
      - {type: http, relay_endpoint: "http://sink", config: {batch_size: 2}}
    model: {materialization: incremental, incremental_strategy: merge, unique_key: order_id}
    transforms:
      pre: >
        frame.filter(col("status") != "CANCELLED")
        .dedup(["order_id"], keep="last")
    columns:
      - {name: order_id, dtype: string, isKey: true, expr: ref("order_id")}
      - {name: total, dtype: float, expr: ref("qty") * ref("price")}
      - name: size
        dtype: string
        expr: >
          when(ref("qty") >= 10, value("BULK"),
          value("SMALL"))
      - {name: run, dtype: string, expr: context.run.run_id}
  - {name: copy, type: computed, depends_on: [orders]}
jobs:
  - {name: load, flow: {definition: "orders_api | orders_file >> orders >> copy"}}
sensors:
  - name: drop
    type: file_drop
    trigger: {type: job, target: load, minimum_interval_seconds: 5}
    config: {file_path: "${DROP:-/nowhere}", file_pattern: "*.csv"}
  - {name: nightly, type: schedule, trigger: {target: load, cron: "0 3 * * *", default_status: STOPPED}}
"""
ROWS = [{"order_id": "1", "qty": 2, "price": 5.0, "status": "NEW"}, {"order_id": "1", "qty": 12, "price": 5.0, "status": "NEW"}, {"order_id": "2", "qty": 1, "price": 1.0, "status": "CANCELLED"}]


class FakeApi:
    def __init__(self, rows):
        self.data = rows

    def rows(self, spark, endpoint, method):
        from weirflow.sources.inference import to_frame

        if self.data is None:
            raise OSError("down")
        return to_frame(spark, self.data)

    def healthy(self, *_):
        return self.data is not None


@pytest.fixture
def runner(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "drop").mkdir()
    (tmp_path / "conf" / "a.macro").write_text(CONFIG)
    p = load(str(tmp_path / "conf"), variables={"DROP": str(tmp_path / "drop")})
    return Runner(spark, p, TableStore(spark, f"file://{tmp_path}/store"), {"api_resource": FakeApi(ROWS)})


def test_a_job_end_to_end(spark, runner, tmp_path):
    (tmp_path / "drop" / "x.csv").write_text("order_id|qty|price|status\n7|1|2.5|NEW\n8|1|NULL|NEW\n")
    done = runner.run_job("load", partition_key=str(tmp_path / "drop" / "x.csv"), run_id="r1")
    table = runner.store.table("demo.orders")
    assert sorted(tuple(r) for r in table.read().collect()) == [("1", 60.0, "BULK", "r1"), ("7", 2.5, "SMALL", "r1"), ("8", None, "SMALL", "r1")]
    assert done["orders"].written["rows_loaded"] == 3 and done["copy"].data.count() == 3
    assert done["orders"].lineage["total"] == {"orders_api": ["price", "qty"], "orders_file": ["price", "qty"]}
    assert all(r.passed for r in done["orders_api"].checks) and table.changes().count() == 3
    # one of the two upstreams is enough
    runner.connections["api_resource"].data = None
    done = runner.run_job("load", partition_key=str(tmp_path / "drop" / "x.csv"), run_id="r2")
    assert "orders_api" not in done and table.read().count() == 3


def test_blocking_checks(runner):
    runner.connections["api_resource"].data = [{"order_id": None, "qty": 1, "price": 1.0, "status": "NEW"}]
    with pytest.raises(CheckFailed, match="order_id_expect_column_values_to_not_be_null"):
        runner.run_job("load")


def test_triggers_and_dispatch(runner, tmp_path):
    sent = []

    class Ok:
        def raise_for_status(self):
            pass

    service = Service(runner)
    changes = next(t for t in service.triggers if t.sensor.type == "cdc")
    changes.dispatcher.put = http_sink(Stream("http", "http://sink"), lambda url, json, timeout: sent.append(json) or Ok())
    now = time.time()
    assert {n: t.skipped for n, t in service.step(now)}["drop"] == "no new file"
    (tmp_path / "drop" / "x.csv").write_text("order_id|qty|price|status\n7|1|2.5|NEW\n8|1|1|NEW\n9|1|1|NEW\n")
    service.step(now + 6)
    assert service.step(now + 12)[0][1].skipped == "no new file"
    service.step(now + 40)
    service.step(now + 80)
    ids = [e["id"] for m in sent for e in m["data"]["events"]]
    assert ids == sorted(ids) and len(ids) == 4 and sent[0]["topic"] == "cdc.orders" and changes.dispatcher.drain() == 0


def test_triggers_go_on_after_a_restart(runner, tmp_path):
    def service():
        made = Service(runner)
        made.triggers = [t for t in made.triggers if t.sensor.type != "cdc"]
        return made

    drop = tmp_path / "drop" / "x.csv"
    drop.write_text("order_id|qty|price|status\n7|1|2.5|NEW\n8|1|1|NEW\n9|1|1|NEW\n")
    now = time.time()
    assert len(dict(service().step(now))["drop"].requests) == 1
    again = service()
    assert dict(again.step(now + 100))["drop"].skipped == "no new file"
    # a file that was found, but whose run failed, is found again
    drop.write_text("order_id|qty|price|status\n7|1|2.5|NEW\n8|1|1|NEW\n9|1|1|NEW\n10|1|1|NEW\n")
    failing = service()
    failing.runner = type("R", (), {"run_job": lambda *a: (_ for _ in ()).throw(OSError("lost"))})()
    with pytest.raises(OSError):
        failing.step(now + 200)
    assert len(dict(service().step(now + 300))["drop"].requests) == 1


def test_kafka_streams_are_delivered_by_spark(spark, tmp_path):
    t = TableStore(spark, str(tmp_path)).table("a.b")
    stream = Stream("kafka", "kafka://host:9092/x", {"acks": "all", "batch_size": 5})
    got = []
    log = dispatcher(spark, t, "b", stream)
    assert isinstance(log, LogStream) and log.tick() == 0
    log.write = lambda df, st, topic: got.extend((topic, r["id"], r["op"]) for r in df.collect())
    for i, n in enumerate((3, 5)):
        t.materialize(spark.range(n), Model("table"), now=dt.datetime(2026, 1, 1 + i), asset="b", track=True)
        assert log.tick() == (3 if n == 3 else 2)
    other = dispatcher(spark, t, "b", stream)
    other.write = log.write
    assert other.tick() == 0  # the position outlives the object
    assert sorted(got) == [("cdc.b", i, "INSERT") for i in range(1, 6)]
    assert kafka_options(stream) == {"kafka.bootstrap.servers": "host:9092", "kafka.acks": "all"}
    with pytest.raises(Exception):
        dispatcher(spark, t, "b", Stream("carrier_pigeon", "x"))


def test_a_batch_that_fails_comes_again(spark, tmp_path):
    table = TableStore(spark, f"file://{tmp_path}").table("t")
    table.materialize(spark.createDataFrame([(i,) for i in range(5)], "k long"), Model("table"), now=dt.datetime(2026, 1, 1), track=True)
    seen, down = [], [True]

    def put(message):
        if down[0]:
            raise OSError("down")
        seen.extend(e["id"] for e in message["events"])

    d = Dispatcher(table, "t", Stream("http", "x"), put, batch_size=2)
    with pytest.raises(OSError):
        d.tick()
    down[0] = False
    assert d.drain() == 5 and seen == [1, 2, 3, 4, 5]
    got = []
    dispatch_stream(log_stream(spark, table), lambda df, _: got.extend(r["id"] for r in df.collect()), f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(got) == seen
    assert envelope("a", [])["count"] == 0


def test_a_drain_reads_the_log_once_for_all_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("weirflow.streaming.dispatch.HELD_EVENTS", 20, raising=False)
    table = TableStore(spark, f"file://{tmp_path}").table("t")
    for i, n in enumerate((60, 101)):
        table.materialize(spark.range(n), Model("table"), now=dt.datetime(2026, 1, 1 + i), track=True)
    reads, sent = [], []
    pending = table.pending
    monkeypatch.setattr(table, "pending", lambda *a: reads.append(a) or pending(*a))

    def put(message):
        if len(sent) == 10 and len(reads) == 1:
            raise OSError("down")
        sent.append([e["id"] for e in message["events"]])

    d = Dispatcher(table, "t", Stream("http", "x"), put, batch_size=2)
    with pytest.raises(OSError):
        d.drain()
    assert d.position() == 20 and d.drain() == 81 and d.drain() == 0
    assert sent == [[i, i + 1] for i in range(1, 101, 2)] + [[101]]
    assert len(reads) == 2


def test_websocket_sink():
    class Socket(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def send(self, text):
            self.append(json.loads(text))

    s = Socket()
    websocket_sink(Stream("websocket", "ws://x"), lambda url: s)({"events": [{"id": 1}]})
    assert s == [[{"id": 1}]]


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,x\n2,y\n")
    got = []
    read = lambda: ingest(file_stream(spark, str(tmp_path / "in"), "k int, v string", pattern="*.csv"), lambda df, _: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"))
    read()
    (tmp_path / "in" / "b.csv").write_text("3,z\n")
    read()
    assert sorted(got) == [(1, "x", "a.csv"), (2, "y", "a.csv"), (3, "z", "b.csv")]


def test_windows(spark):
    t = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([(t + dt.timedelta(minutes=m), "u") for m in (0, 1, 7, 30)], "ts timestamp, u string")
    assert [r["n"] for r in tumbling(e, "ts", "5 minutes", ["u"], F.count("*").alias("n")).orderBy("window_start").collect()] == [2, 1, 1]
    assert [r["n"] for r in sessions(e, "ts", "10 minutes", ["u"], F.count("*").alias("n")).orderBy("session_start").collect()] == [3, 1]


def test_stream_duplicates(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "ts": "2026-01-01T00:00:00Z"}\n{"id": 1, "ts": "2026-01-01T00:00:05Z"}\n{"id": 2, "ts": "2026-01-01T00:00:00Z"}\n')
    s = file_stream(spark, str(tmp_path), "id long, ts timestamp", "json", "*.json")
    got = []
    ingest(deduplicated(s, "ts", "1 hour", ["id"]), lambda df, _: got.extend(r["id"] for r in df.collect()), str(tmp_path / "cp"))
    assert sorted(got) == [1, 2]


def test_cron():
    c = Cron("*/15 3,4 1-7 * 1")
    assert c.matches(dt.datetime(2026, 6, 1, 3, 45)) and not c.matches(dt.datetime(2026, 6, 1, 5, 0))
    assert Cron("0 3 * * *").after(dt.datetime(2026, 1, 1, 3, 0)) == dt.datetime(2026, 1, 2, 3, 0)
    assert Cron("0 0 * * 7").after(dt.datetime(2026, 1, 1)).weekday() == 6
    for bad in ("* * * *", "61 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            Cron(bad)


@pytest.mark.parametrize(
    "bad",
    [
        {"assets": [{"name": "a", "type": "blob"}]},
        {"assets": [{"name": "a", "type": "api", "model": {"materialization": "table"}}]},
        {"assets": [{"name": "a", "type": "api", "change_tracking": True}]},
        {"assets": [{"name": "a", "type": "database", "change_tracking": True}]},
        {"assets": [{"name": "a", "type": "database", "streams": [{"type": "http", "relay_endpoint": "x"}]}]},
        {"assets": [{"name": "a", "type": "computed"}]},
        {"assets": [{"name": "a", "type": "api", "tests": ["no_such_rule"]}]},
        {"assets": [{"name": "a", "type": "api", "columns": [{"name": "x", "dtype": "blob"}]}]},
        {"assets": [{"name": "a", "type": "file", "file_format": "none"}]},
        {"assets": [{"name": "a", "type": "api"}], "jobs": [{"name": "j", "flow": {"definition": "a >> b"}}]},
        {"assets": [{"name": "a", "type": "api"}], "sensors": [{"name": "s", "type": "schedule", "trigger": {"target": "a"}}]},
    ],
)
def test_bad_configurations(bad):
    with pytest.raises(ValueError):
        build(bad)


def test_names_come_once(tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.macro").write_text("assets: [{name: x, type: api}]")
    with pytest.raises(ValueError, match="comes twice"):
        load(str(tmp_path))
