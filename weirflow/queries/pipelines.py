"""Queries of sources, flows, triggers, delivery, templates and registries, with their SQL. Networks are replaced by functions that answer from the tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.columns import column_function
from weirflow.operators.quality import Check, Counted, rules, validate
from weirflow.operators.tables import Model, TableStore
from weirflow.plans.flow import lineage, parse_flow
from weirflow.plans.frame import transform
from weirflow.plans.pipeline import Runner
from weirflow.plans.projection import Declared, project
from weirflow.plans.spec import Stream, build
from weirflow.queries.engine import LATER, NOW, _customers, _logged, _V1, _V2, fresh
from weirflow.registry import column_functions, connections, sinks, sources
from weirflow.session import opened, scratch, table
from weirflow.sources.connections import Jdbc
from weirflow.sources.discovery import Cursor, listed, object_files
from weirflow.sources.feeds import Api
from weirflow.sources.files import Format, kind_of, read_file
from weirflow.sources.templates import render, template_function, template_functions
from weirflow.streaming.dispatch import Dispatcher, LogStream, dispatch_stream, http_sink, log_stream, websocket_sink
from weirflow.streaming.triggers import Cron, Service

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def refused(what: Callable[[], Any]) -> bool:
    try:
        what()
    except (ValueError, KeyError, TypeError):
        return True
    return False


def runner(spark: SparkSession, config: dict[str, Any], given: dict[str, Any] | None = None) -> Runner:
    return Runner(spark, build(config), TableStore(spark, scratch(spark, "store")), given)


class Answer:
    """What a request gives."""

    def __init__(self, data: Any) -> None:
        self.data, self.ok = data, True

    def json(self) -> Any:
        return self.data

    def raise_for_status(self) -> None:
        pass


def _nations(spark: SparkSession, sf: str) -> list[dict[str, Any]]:
    return [{"id": r["n_nationkey"], "name": r["n_name"], "region": r["n_regionkey"]} for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]  # 25 rows


_NATIONS = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"


# --- sources as assets ---------------------------------------------------------------------------------------------


@query("asset_api", _NATIONS)
def asset_api(spark: SparkSession, sf: str) -> DataFrame:
    """An API asset, stored: a GET below the resource's address, typed by all values."""
    rows = _nations(spark, sf)
    send = lambda method, url, **_: Answer(rows if (method, url) == ("GET", "http://host/v1/nations") else [])
    config = {
        "resources": [{"name": "api_resource", "type": "api", "config": {"base_url": "http://host/v1/"}}],
        "assets": [{"name": "nations", "type": "api", "source": {"endpoint": "/nations"}}, {"name": "stored", "type": "database", "depends_on": ["nations"], "source": {"table": "d.nations"}}],
        "jobs": [{"name": "j", "flow": "nations >> stored"}],
    }
    r = runner(spark, config)
    r.connection("api_resource").send = send
    r.run_job("j")
    return r.store.table("d.nations").read()


@query("asset_event", _NATIONS + " WHERE n_regionkey = 2")
def asset_event(spark: SparkSession, sf: str) -> DataFrame:
    """An event asset: what a queue holds of one type."""
    rows = _nations(spark, sf)

    class Queue:
        def consume(self, event_type: str | None = None) -> list[dict[str, Any]]:
            return [x for x in rows if f"region-{x['region']}" == event_type]

    config = {"assets": [{"name": "seen", "type": "event", "source": {"resource": "queue", "event_type": "region-2"}}], "jobs": [{"name": "j", "flow": "seen"}]}
    return runner(spark, config, {"queue": Queue()}).run_job("j")["seen"].data


@query("asset_computed_and_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def asset_computed_and_sql(spark: SparkSession, sf: str) -> DataFrame:
    """A computed asset hands its upstream on; an SQL model reads it by name."""
    config = {
        "assets": [
            {"name": "raw", "type": "file", "source": {"path": f"{sf}/orders.parquet"}},
            {"name": "same", "type": "computed", "depends_on": ["raw"]},
            {"name": "counted", "type": "dbt", "depends_on": ["same"], "source": {"sql": "SELECT o_orderstatus, count(*) AS n FROM {same} GROUP BY o_orderstatus"}},
        ],
        "jobs": [{"name": "j", "flow": "raw >> same >> counted"}],
    }
    return runner(spark, config).run_job("j")["counted"].data


@query("asset_union_of_upstreams", "SELECT c_custkey AS id, upper(c_name) AS name FROM customer UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_nationkey < 5")
def asset_union_of_upstreams(spark: SparkSession, sf: str) -> DataFrame:
    """Two upstreams, projected by the same columns, are one table."""
    part = scratch(spark, "part") + "/some.parquet"
    table(spark, sf, "customer").filter("c_nationkey < 5").write.parquet(part)
    config = {
        "assets": [
            {"name": "a", "type": "file", "source": {"path": f"{sf}/customer.parquet"}},
            {"name": "b", "type": "file", "source": {"path": part}},
            {"name": "both", "type": "database", "depends_on": ["a", "b"], "source": {"table": "d.both"}, "columns": [{"name": "id", "dtype": "int", "expr": 'ref("c_custkey")'}, {"name": "name", "dtype": "string", "expr": 'upper(ref("c_name"))'}]},
        ],
        "jobs": [{"name": "j", "flow": "a, b >> both"}],
    }
    r = runner(spark, config)
    r.run_job("j")
    return r.store.table("d.both").read()


@query("asset_any_upstream", "SELECT c_custkey, c_name FROM customer")
def asset_any_upstream(spark: SparkSession, sf: str) -> DataFrame:
    """Whichever upstream there is: one of the two can't be read."""
    config = {
        "assets": [
            {"name": "gone", "type": "file", "source": {"path": f"{sf}/absent.parquet"}},
            {"name": "here", "type": "file", "source": {"path": f"{sf}/customer.parquet"}},
            {"name": "one", "type": "database", "depends_on": [], "source": {"table": "d.one"}, "columns": [{"name": "c_custkey", "expr": 'ref("c_custkey")'}, {"name": "c_name", "expr": 'ref("c_name")'}]},
        ],
        "jobs": [{"name": "j", "flow": "gone | here >> one"}],
    }
    r = runner(spark, config)
    r.run_job("j")
    return r.store.table("d.one").read()


@query("asset_of_a_registered_source", "SELECT r_regionkey + 1 AS n, 'numbers' AS asset FROM region")
def asset_of_a_registered_source(spark: SparkSession, sf: str) -> DataFrame:
    """A source and a connection of one's own kind."""
    sources.remove("counter")
    connections.remove("limit")
    connections.register("limit")(lambda upto=0, **_: int(upto))
    sources.register("counter")(lambda session, asset, run: session.range(1, r.connection("most") + 1).select(F.col("id").alias("n"), F.lit(asset.name).alias("asset")))
    config = {"resources": [{"name": "most", "type": "limit", "config": {"upto": table(spark, sf, "region").count()}}], "assets": [{"name": "numbers", "type": "counter"}], "jobs": [{"name": "j", "flow": "numbers"}]}
    r = runner(spark, config)
    return r.run_job("j")["numbers"].data


@query("jdbc_roundtrip", _NATIONS)
def jdbc_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written to and read from a database in two partitions; here one that lives in the process."""
    db = Jdbc(f"jdbc:derby:memory:{scratch(spark, 'db').rsplit('/', 1)[-1]};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(1).alias("extra"))
    db.write(rows, "nations", ["id", "name", "region"], mode="overwrite", partitions=2)
    got = db.read(spark, "nations", "id", 0, 25, 2)
    return got.toDF(*[c.lower() for c in got.columns])


@query("excel_scan", "SELECT s_suppkey, s_name, s_acctbal, s_nationkey > 12 AS big, TIMESTAMP '2026-01-01' + to_days(s_nationkey) AS day FROM supplier")
def excel_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook as an office program packs it: shared texts, numbers, truth values, days as styled numbers, a line before the names."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    rows = table(spark, sf, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey").collect()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    texts = sorted({r["s_name"] for r in rows})
    at = {t: i for i, t in enumerate(texts)}
    names = "".join(f'<c r="{c}2" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABCDE", ("s_suppkey", "s_name", "s_acctbal", "big", "day")))
    body = "".join(f'<row r="{i}"><c r="A{i}"><v>{r["s_suppkey"]}</v></c><c r="B{i}" t="s"><v>{at[r["s_name"]]}</v></c><c r="C{i}"><v>{r["s_acctbal"]!r}</v></c><c r="D{i}" t="b"><v>{int(r["s_nationkey"] > 12)}</v></c><c r="E{i}" s="1"><v>{46023 + r["s_nationkey"]}</v></c></row>' for i, r in enumerate(rows, 3))
    files = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Parts" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in texts) + "</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>made today</t></is></c></row><row r="2">{names}</row>{body}</sheetData></worksheet>',
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in files.items():
            z.writestr(n, x)
    to = scratch(spark, "excel") + "/parts.xlsx"
    place, inner = opened(to)
    place.create_dir(inner.rsplit("/", 1)[0])
    with place.open_output_stream(inner) as f:
        f.write(held.getvalue())
    got = read_file(spark, to, Format("parts", "excel", {"skip_header": 1, "sheet_name": "Parts"}))
    return got.drop("file_name").withColumn("day", F.col("day").cast("timestamp_ntz"))


# --- finding files -------------------------------------------------------------------------------------------------


def _landing(spark: SparkSession, sf: str) -> str:
    """A file of names per region, one name a line."""
    to = scratch(spark, "landing")
    lines = table(spark, sf, "nation").repartition(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    lines.select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(to)
    return to


_LANDING = "SELECT n_regionkey AS region, md5(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS md5, sum(strlen(n_name) + 1)::bigint AS size FROM nation GROUP BY n_regionkey"


def _region(path: str) -> Any:
    return F.regexp_extract(path, "n_regionkey=([0-9]+)", 1).cast("long")


@query("files_listed", _LANDING)
def files_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Files with sizes and checksums, listed by Spark."""
    found = listed(spark, _landing(spark, sf) + "/*", "*.txt", checksum=True)
    return found.select(_region("path").alias("region"), "md5", "size")


@query("files_new_or_changed", "SELECT n_regionkey AS region, 'new' AS why FROM nation WHERE n_regionkey <> 4 GROUP BY ALL UNION ALL SELECT 1, 'changed' UNION ALL SELECT 4, 'new'")
def files_new_or_changed(spark: SparkSession, sf: str) -> DataFrame:
    """A cursor that is kept: at first all files but one that comes later; then, read back, the late one and one that changed."""
    at = _landing(spark, sf)
    kept: list[str] = []
    keep = lambda *text: kept.append(text[0]) if text else (kept[-1] if kept else None)

    def found() -> list[tuple[str, dict[str, Any]]]:
        rows = listed(spark, at + "/*", "*.txt", checksum=True).select(_region("path").alias("region"), "md5").orderBy("region").collect()
        return [(str(r["region"]), {"md5": r["md5"]}) for r in rows]

    first = Cursor(keep=keep)
    out = [(int(p), "new") for p in first.fresh(x for x in found() if x[0] != "4")]
    first.commit()
    spark.range(1).selectExpr("'other' AS value").coalesce(1).write.mode("overwrite").text(f"{at}/n_regionkey=1")
    second = Cursor(keep=keep)
    before = set(second.seen)
    out += [(int(p), "changed" if p in before else "new") for p in second.fresh(found())]
    return spark.createDataFrame(out, "region long, why string")


@query("objects_found", "SELECT 's3a://lake/in/' || n_name || '.csv' AS path, md5(n_name) AS etag FROM nation WHERE starts_with(n_name, 'N') OR n_regionkey < 3")
def objects_found(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of a bucket by prefix, pattern and a test of one's own, page by page."""
    import hashlib

    rows = _nations(spark, sf)
    objects = [{"Key": f"in/{x['name']}.csv", "ETag": '"' + hashlib.md5(x["name"].encode()).hexdigest() + '"'} for x in rows] + [{"Key": "in/notes.txt", "ETag": '"x"'}, {"Key": "in/", "ETag": '"y"'}]

    class Client:
        def get_paginator(self, _: str) -> Client:
            return self

        def paginate(self, Bucket: str, Prefix: str) -> Any:  # noqa: N803 - as the service names them
            fits = [o for o in objects if Bucket == "lake" and o["Key"].startswith(Prefix)]
            return ({"Contents": fits[i : i + 7]} for i in range(0, len(fits), 7))

    wanted = {f"in/{x['name']}.csv" for x in rows if x["name"].startswith("N") or x["region"] < 3}
    found = object_files(Client(), "lake", "in/", "*.csv", keep=wanted.__contains__)
    return spark.createDataFrame([(p, m["etag"]) for p, m in found], "path string, etag string")


@query("templates", "SELECT r_regionkey, '/lake/' || upper(r_name) || '/none/' || r_regionkey || '/${UNSET}' AS path FROM region")
def templates(spark: SparkSession, sf: str) -> DataFrame:
    """Variables with and without defaults, and a function registered for templates."""
    template_functions.remove("shout")

    @template_function
    def shout(text: str) -> str:
        return text.upper()

    rows = table(spark, sf, "region").collect()
    return spark.createDataFrame([(r["r_regionkey"], render("/lake/{shout(text='" + r["r_name"] + "')}/${OTHER:-none}/${KEY}/${UNSET}", {"KEY": str(r["r_regionkey"])})) for r in rows], "r_regionkey long, path string")


# --- flows, lineage, triggers --------------------------------------------------------------------------------------


_FLOWS = {"a >> b >> c": "a,b,c", "c << b << a": "a,b,c", "[a, b] >> c >> [d, e]": "a,b,c,d,e", "a, b >> c": "a,b,c", "a | b >> c": "a,b,c"}
_EDGES = {
    "a >> b >> c": "a>b b>c", "c << b << a": "a>b b>c", "[a, b] >> c >> [d, e]": "a>c b>c c>d c>e", "a, b >> c": "a>c b>c", "a | b >> c": "a>c b>c",
}


@query("flows", "SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{o}', '{_EDGES[d]}', {str('|' in d).lower()})" for d, o in _FLOWS.items()) + ") f(flow, nodes, edges, any_upstream)")
def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Chains both ways, fan-out, fan-in and alternatives: nodes in order, edges, and whether any upstream will do."""
    out = []
    for d in _FLOWS:
        f = parse_flow(d)
        order = f.order()
        fine = all(order.index(u) < order.index(n) for n, ups in f.upstream.items() for u in ups)
        out.append((d, ",".join(sorted(order)) if fine else "", " ".join(sorted(f"{u}>{n}" for n, ups in f.upstream.items() for u in ups)), bool(f.optional)))
    return spark.createDataFrame(out, "flow string, nodes string, edges string, any_upstream boolean")


_REFUSED = ["cycle", "malformed flow", "unbalanced list", "chain without a frame", "changed schema", "repeated keys", "snapshot without key", "unknown strategy", "unknown file type", "unknown rule", "unknown resource", "unknown sink", "bad cron", "unknown trigger"]


@query("refusals", "SELECT unnest([" + ", ".join(f"'{x}'" for x in _REFUSED) + "]) AS what, true AS refused")
def refusals(spark: SparkSession, sf: str) -> DataFrame:
    """What configurations and writes must not pass."""
    n = table(spark, sf, "nation")
    strict, keyed = fresh(spark, "strict"), fresh(spark, "keyed")
    strict.materialize(n, Model("incremental", on_schema_change="fail"), now=NOW)
    tries: dict[str, Callable[[], Any]] = {
        "cycle": lambda: parse_flow("a >> b >> a").order(),
        "malformed flow": lambda: parse_flow("a >> >> b"),
        "unbalanced list": lambda: parse_flow("[a, b >> c"),
        "chain without a frame": lambda: transform(n, 'col("n_name")'),
        "changed schema": lambda: strict.materialize(n.withColumn("more", F.lit(1)), Model("incremental", on_schema_change="fail"), now=LATER),
        "repeated keys": lambda: keyed.materialize(n.unionByName(n), Model("table"), [Declared("n_nationkey", key=True)], now=NOW),
        "snapshot without key": lambda: Model("snapshot", strategy="check", check_cols=["x"]),
        "unknown strategy": lambda: Model("incremental", ["k"], "upsert"),
        "unknown file type": lambda: kind_of("table.doc"),
        "unknown rule": lambda: build({"assets": [{"name": "a", "type": "api", "tests": ["expect_nothing"]}]}),
        "unknown resource": lambda: runner(spark, {}).connection("none"),
        "unknown sink": lambda: sinks.get("none"),
        "bad cron": lambda: Cron("61 * * * *"),
        "unknown trigger": lambda: build({"sensors": [{"name": "s", "type": "none"}]}),
    }
    return spark.createDataFrame([(k, refused(tries[k])) for k in _REFUSED], "what string, refused boolean")


@query("column_lineage", "SELECT * FROM (VALUES ('net', 'lines', 'l_discount,l_extendedprice'), ('who', 'lines', 'l_suppkey'), ('who', 'suppliers', 's_name'), ('size', 'lines', 'l_quantity')) t(name, upstream, fields)")
def column_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of each upstream that a column's expression reads."""
    lines, suppliers = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    joined = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    declared = [Declared("net", "float", 'ref("l_extendedprice") * (1 - ref("l_discount"))'), Declared("who", "string", 'concat(ref("s_name"), "/", ref("l_suppkey"))'), Declared("size", "string", 'when(ref("l_quantity") > 10, value("L"), value("S"))'), Declared("fix", "int", "value(1)")]
    found = lineage(project(joined, declared).lineage, {"lines": lines.columns, "suppliers": suppliers.columns})
    return spark.createDataFrame([(c, u, ",".join(f)) for c, by in found.items() for u, f in by.items()], "name string, upstream string, fields string")


@query("cron_times", "SELECT d AS day, CASE WHEN isodow(d) = 1 THEN d ELSE date_trunc('week', d) + INTERVAL 7 DAY END + INTERVAL 6 HOUR + INTERVAL 30 MINUTE AS monday, last_day(d) + INTERVAL 1 DAY AS month FROM (SELECT DISTINCT cast(o_orderdate AS DATE) AS d FROM orders)")
def cron_times(spark: SparkSession, sf: str) -> DataFrame:
    """The next Monday at half past six, and the next first of a month, after each day of orders."""
    monday, month = Cron("30 6 * * 1"), Cron("0 0 1 * *")
    days = [r[0] for r in table(spark, sf, "orders").select(F.col("o_orderdate").cast("date")).distinct().collect()]  # days of some years
    found = []
    for d in days:
        t = datetime(d.year, d.month, d.day)
        found.append((d, monday.after(t), month.after(t + timedelta(minutes=1) - timedelta(seconds=1))))
    return spark.createDataFrame(found, "day date, monday timestamp_ntz, month timestamp_ntz")


@query(
    "trigger_ticks",
    "SELECT * FROM (VALUES (1, 'every', 1), (1, 'healthy', 1), (1, 'unhealthy', 0), (1, 'written', 0), (1, 'watched', 0), (2, 'every', 1), (2, 'healthy', 1), (2, 'unhealthy', 0), (2, 'written', 1), (2, 'watched', 0), (3, 'written', 0)) t(round, sensor, runs)",
)
def trigger_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds of a service: an interval, API checks, and a trigger that waits for a write. The third round comes before the others are due."""
    sensor = lambda name, kind, seconds, **config: {"name": name, "type": kind, "trigger": {"target": "j", "minimum_interval_seconds": seconds}, "config": config}
    config = {
        "resources": [{"name": "up", "type": "api", "config": {"base_url": "http://up"}}, {"name": "down", "type": "api", "config": {"base_url": "http://down"}}],
        "assets": [{"name": "raw", "type": "file", "source": {"path": f"{sf}/region.parquet"}}, {"name": "stored", "type": "database", "depends_on": ["raw"], "source": {"table": "d.stored"}}, {"name": "other", "type": "file", "source": {"path": f"{sf}/nation.parquet"}}],
        "jobs": [{"name": "j", "flow": "other"}, {"name": "store", "flow": "raw >> stored"}],
        "sensors": [sensor("every", "polling", 30), sensor("healthy", "api_polling", 30, resource="up", endpoint="x"), sensor("unhealthy", "api_polling", 30, resource="down", endpoint="x"), sensor("written", "event", 10, asset="stored"), sensor("watched", "asset_update", 30, asset="stored")],
    }
    r = runner(spark, config)
    for name in ("up", "down"):
        answer = Answer([])
        answer.ok = name == "up"
        r.connection(name).send = lambda *_, a=answer, **__: a
    service, now, out = Service(r), time.time(), []
    for i, at in enumerate((0, 31, 42), 1):
        if i == 2:
            r.run_job("store")
        out += [(i, name, len(t.requests)) for name, t in service.step(now + at)]
    return spark.createDataFrame(out, "round int, sensor string, runs int")


# --- change logs and their delivery --------------------------------------------------------------------------------

_EVENTS = f"""WITH o AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM ({_V1})), n AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM ({_V2})),
x AS (SELECT 'r01' AS run_id, 'INSERT' AS op, '{{"c_custkey":' || c_custkey || '}}' AS pk, NULL AS before_data,
    '{{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}}' AS after_data FROM o
  UNION ALL SELECT 'r02', CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END, '{{"c_custkey":' || coalesce(n.c_custkey, o.c_custkey) || '}}',
    CASE WHEN o.c_custkey IS NOT NULL THEN '{{"c_nationkey":' || o.c_nationkey || ',"c_mktsegment":"' || o.c_mktsegment || '"}}' END,
    CASE WHEN n.c_custkey IS NOT NULL THEN '{{"c_nationkey":' || n.c_nationkey || ',"c_mktsegment":"' || n.c_mktsegment || '"}}' END
  FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_mktsegment <> n.c_mktsegment),
events AS (SELECT row_number() OVER (ORDER BY run_id, pk) AS id, 'customers' AS asset_name, * FROM x)
"""
_EVENT = "id, asset_name, op, pk, before_data, after_data, run_id"


@query("change_log_rows", _EVENTS + f"SELECT {_EVENT} FROM events")
def change_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every event with its number and both images."""
    return _logged(spark, sf).changes().drop("captured_at")


@query("change_log_fetch", _EVENTS + f"SELECT {_EVENT} FROM events WHERE id > 100 ORDER BY id LIMIT 100")
def change_log_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """The next hundred changes after a number: the batch of a dispatch tick."""
    return _logged(spark, sf).pending(100, 100).drop("captured_at")


@query("cdc_http_dispatch", _EVENTS + "SELECT id, op, pk, 'cdc.customers' AS topic, cast((id - 1) // 500 AS BIGINT) AS batch FROM events")
def cdc_http_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of five hundred to an HTTP endpoint that fails once; what it takes in the end, put down in a file as it comes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    calls: list[int] = []
    kept = pa.schema({"id": pa.int64(), "op": pa.string(), "pk": pa.string(), "topic": pa.string(), "batch": pa.int64()})

    def post(url: str, json: dict, timeout: float) -> Answer:  # noqa: A002 - as the client names it
        calls.append(1)
        if len(calls) == 2:
            raise OSError("no answer")
        taken = len(calls) - 1 - (len(calls) > 2)
        rows = [{**{k: e[k] for k in ("id", "op", "pk")}, "topic": json["topic"], "batch": taken} for e in json["data"]["events"]]
        file.write_batch(pa.RecordBatch.from_pylist(rows, kept))
        return Answer(None)

    stream = Stream("http", "http://sink", {"batch_size": 500})
    t = _logged(spark, sf)
    to = scratch(spark, "taken")
    place, inner = opened(to)
    place.create_dir(inner)
    with place.open_output_stream(f"{inner}/events.parquet") as out, pq.ParquetWriter(out, kept) as file:
        d = Dispatcher(t, "customers", stream, http_sink(stream, post))
        try:
            d.drain()
        except OSError:
            Dispatcher(t, "customers", stream, http_sink(stream, post)).drain()
    return spark.read.schema("id long, op string, pk string, topic string, batch long").parquet(to)


@query("cdc_websocket_dispatch", _EVENTS + "SELECT op, count(*) AS n FROM events GROUP BY ALL")
def cdc_websocket_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    sent: list[dict] = []

    class Socket:
        def __enter__(self) -> Socket:
            return self

        def __exit__(self, *_: Any) -> None:
            pass

        def send(self, text: str) -> None:
            sent.extend(json.loads(text))

    stream = Stream("websocket", "ws://sink", {"batch_size": 1000})
    Dispatcher(_logged(spark, sf), "customers", stream, websocket_sink(stream, lambda _: Socket())).drain()
    return spark.createDataFrame([(e["op"],) for e in sent], "op string").groupBy("op").agg(F.count("*").alias("n"))


@query("cdc_stream_dispatch", _EVENTS + f"SELECT {_EVENT} FROM events")
def cdc_stream_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream, delivered in micro-batches to a folder."""
    t = _logged(spark, sf)
    to = scratch(spark, "delivered")
    dispatch_stream(log_stream(spark, t), lambda df, i: df.write.mode("overwrite").parquet(f"{to}/batch={i}"), scratch(spark, "position")).awaitTermination()
    return spark.read.parquet(to).drop("batch", "captured_at")


@query("cdc_kafka_stream", _EVENTS + "SELECT id, pk AS key, op FROM events")
def cdc_kafka_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log as keyed records, sent by the executors; here a folder takes the topic's place."""
    to = scratch(spark, "topic")

    def write(df: DataFrame, stream: Stream, topic: str) -> None:
        df.select("id", F.col("pk").alias("key"), "op").write.mode("append").parquet(to)

    log = LogStream(spark, _logged(spark, sf), "customers", Stream("kafka", "kafka://host:9092"), write)
    log.tick()
    log.tick()  # nothing new
    return spark.read.parquet(to)


@query(
    "scd2_reappearing",
    """SELECT c_custkey, TIMESTAMP '2026-01-01' AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2026-02-01' END AS valid_to, c_custkey % 3 <> 0 AS is_current, c_custkey % 3 = 0 AS is_deleted FROM customer
    UNION ALL SELECT c_custkey, TIMESTAMP '2026-03-01', NULL, true, false FROM customer WHERE c_custkey % 3 = 0""",
)
def scd2_reappearing(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a snapshot lacks are closed, and open a new version when they come back."""
    t = fresh(spark, "reappearing")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    model = Model("snapshot", ["c_custkey"], strategy="check", check_cols=["c_name"], hard_deletes="invalidate")
    for i, rows in enumerate((c, c.filter("c_custkey % 3 <> 0"), c), 1):
        t.materialize(rows, model, now=datetime(2026, i, 1, tzinfo=timezone.utc))
    return t.read().drop("c_name").withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("valid_from", "valid_to")})


@query("write_and_log_are_one", "SELECT count(*) AS n_rows, (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS n_events, 1 AS version FROM customer WHERE c_mktsegment <> 'BUILDING'")
def write_and_log_are_one(spark: SparkSession, sf: str) -> DataFrame:
    """A write whose log can't be made leaves rows, log and version as they were."""
    t = fresh(spark, "atomic")
    keys = [Declared("c_custkey", key=True), Declared("c_nationkey"), Declared("c_mktsegment")]
    old, new = (x.drop("at") for x in _customers(spark, sf))
    t.materialize(old, Model("table"), keys, now=NOW, asset="c", track=True)

    def fails(*_: Any) -> None:
        raise OSError("disk full")

    t._log = fails
    try:
        t.materialize(new, Model("table"), keys, now=LATER, asset="c", track=True)
    except OSError:
        pass
    again = type(t)(spark, t.path)
    return spark.createDataFrame([(again.read().count(), again.changes().count(), again.manifest().version)], "n_rows long, n_events long, version int")


# --- functions and rules of one's own, clocks and identifiers -------------------------------------------------------


@query("plugin_function", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def plugin_function(spark: SparkSession, sf: str) -> DataFrame:
    column_functions.remove("net_of")

    @column_function("net_of")
    def net_of(scope: Any, price: Any, discount: Any) -> Any:
        from weirflow.plans.terms import column_of

        return column_of(price) * (1 - column_of(discount))

    return project(table(spark, sf, "lineitem"), [Declared("l_orderkey", None, 'ref("l_orderkey")'), Declared("l_linenumber", None, 'ref("l_linenumber")'), Declared("net", "float", 'net_of(ref("l_extendedprice"), ref("l_discount"))')]).data


@query("plugin_rule", "SELECT 'expect_even' AS rule, count(*) = 0 AS passed, count(*) AS violations FROM orders WHERE o_custkey % 2 = 1")
def plugin_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A rule of one's own, counted in the one pass of all rules."""
    rules.remove("expect_even")
    rules.register("expect_even")(lambda df, c: Counted({"odd": F.count_if(F.col(c.column) % 2 == 1)}, lambda n: (n["odd"] == 0, {"violations": n["odd"]})))
    r = validate(table(spark, sf, "orders"), [Check("expect_even", "o_custkey")])[0]
    return spark.createDataFrame([(r.rule, r.passed, r.metadata["violations"])], "rule string, passed boolean, violations long")


@query(
    "to_datetime_formats",
    "SELECT row_id, try_strptime(trim(date), '%Y-%m-%d') AS iso, try_strptime(trim(date), '%Y/%m/%d') AS slashed, try_strptime(trim(date), '%d-%b-%Y') AS named FROM account_file",
)
def to_datetime_formats(spark: SparkSession, sf: str) -> DataFrame:
    names = {"iso": "%Y-%m-%d", "slashed": "%Y/%m/%d", "named": "%d-%b-%Y"}
    declared = [Declared("row_id", None, 'ref("row_id")'), *[Declared(n, None, f'to_datetime(ref("date"), "{f}")') for n, f in names.items()]]
    return project(table(spark, sf, "account_file"), declared).data.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("now_today", "SELECT c_custkey, true AS same_day, true AS same_date, true AS near FROM customer")
def now_today(spark: SparkSession, sf: str) -> DataFrame:
    """One clock for a whole frame: the moment lies in the day, under both spellings."""
    declared = [Declared("c_custkey", None, 'ref("c_custkey")'), Declared("n", None, "now()"), Declared("t", None, "today()"), Declared("u", None, "pd.Timestamp.utcnow()"), Declared("d", None, "pd.Timestamp.utcnow().date()")]
    out = project(table(spark, sf, "customer"), declared).data
    return out.select("c_custkey", (F.to_date("n") == F.to_date("t")).alias("same_day"), (F.to_date("d") == F.to_date("t")).alias("same_date"), (F.abs(F.unix_seconds(F.col("n").cast("timestamp")) - F.unix_seconds(F.col("u").cast("timestamp"))) < 60).alias("near"))


@query("uuid_key", "SELECT count(*) AS n, count(*) AS different, count(*) AS well_formed FROM lineitem")
def uuid_key(spark: SparkSession, sf: str) -> DataFrame:
    out = project(table(spark, sf, "lineitem"), [Declared("k", None, "uuid_key()")]).data
    return out.agg(F.count("*").alias("n"), F.count_distinct("k").alias("different"), F.count_if(F.col("k").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"))


@query("arithmetic_on_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_extendedprice / l_quantity > 1500 AND l_quantity * 2 - l_linenumber >= 10")
def arithmetic_on_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return transform(rows, 'frame.filter((col("l_extendedprice") / col("l_quantity") > 1500) & (col("l_quantity") * 2 - col("l_linenumber") >= 10))').df()


@query("group_text_sum", "SELECT o_orderstatus, string_agg(o_orderpriority, '' ORDER BY o_orderkey) AS joined FROM orders GROUP BY ALL")
def group_text_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are summed by joining them in the frame's order."""
    chain = 'frame.order_by("o_orderkey").group_by(["o_orderstatus"]).agg(agg_sum("o_orderpriority").alias("joined"))'
    return transform(table(spark, sf, "orders"), chain).data
