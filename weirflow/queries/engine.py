"""Queries of writes, history, change logs, validation, sources and streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.changes import compute_changes, row_diff
from weirflow.operators.quality import Check, validate
from weirflow.operators.tables import Model, Table
from weirflow.plans.projection import Declared
from weirflow.session import scratch, table
from weirflow.sources.files import Format, read_csv, read_file
from weirflow.sources.inference import to_frame
from weirflow.streaming.ingest import file_stream, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW, LATER = datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 2, 1, tzinfo=timezone.utc)
T1, T2 = "TIMESTAMP '2026-01-01'", "TIMESTAMP '2026-02-01'"


def query(name: str, sql: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def fresh(spark: SparkSession, label: str) -> Table:
    return Table(spark, scratch(spark, label))


# --- writes --------------------------------------------------------------------------------------------------------

ORDERS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
OS = ", ".join(ORDERS)


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A first state without the orders still in process, and a batch of all that aren't final, dearer by one."""
    o = table(spark, sf, "orders").select(*ORDERS)
    return o.filter("o_orderstatus <> 'P'"), o.filter("o_orderstatus <> 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)


_S = f"SELECT {OS} FROM orders WHERE o_orderstatus <> 'P'"
_B = "SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"


@query("table_full_refresh", _B)
def table_full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    t = fresh(spark, "refresh")
    for rows in _orders(spark, sf):
        t.materialize(rows, Model("table"), [Declared(c, key=c == "o_orderkey") for c in ORDERS], now=NOW)
    return t.read()


@query("append_incremental", f"{_S} UNION ALL {_B}")
def append_incremental(spark: SparkSession, sf: str) -> DataFrame:
    t = fresh(spark, "append")
    for rows in _orders(spark, sf):
        t.materialize(rows, Model("incremental"), now=NOW)
    return t.read()


@query("merge_upsert", f"{_B} UNION ALL SELECT * FROM ({_S}) WHERE o_orderstatus = 'F'")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    t = fresh(spark, "merge")
    for rows in _orders(spark, sf):
        t.materialize(rows, Model("incremental", ["o_orderkey"], "merge"), now=NOW)
    return t.read()


@query("merge_composite_key", "SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL")
def merge_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by order and number, upserted in two halves; the largest quantity last."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    t = fresh(spark, "composite")
    model = Model("incremental", ["l_orderkey", "l_linenumber"], "merge")
    t.materialize(rows.withColumn("l_quantity", F.lit(0.0)), model, now=NOW)
    t.materialize(rows, model, now=NOW)
    return t.read()


@query("delete_insert", f"SELECT * FROM ({_S}) WHERE o_custkey NOT IN (SELECT o_custkey FROM ({_B})) UNION ALL {_B}")
def delete_insert(spark: SparkSession, sf: str) -> DataFrame:
    t = fresh(spark, "replace")
    for rows in _orders(spark, sf):
        t.materialize(rows, Model("incremental", ["o_custkey"], "delete+insert"), now=NOW)
    return t.read()


def _drift(policy: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        first, batch = _orders(spark, sf)
        t = fresh(spark, "drift")
        model = Model("incremental", on_schema_change=policy)
        t.materialize(first, model, now=NOW)
        t.materialize(batch.withColumn("o_totalprice", F.col("o_totalprice").cast("long")).withColumn("extra", F.lit("x")).drop("o_orderstatus"), model, now=NOW)
        return t.read()

    return run


_LONG = "cast(trunc(o_totalprice) AS {})"
query("schema_ignore", f"{_S} UNION ALL SELECT o_orderkey, o_custkey, {_LONG.format('DOUBLE')}, NULL FROM ({_B})")(_drift("ignore"))
query("schema_append_new_columns", f"SELECT *, CAST(NULL AS VARCHAR) AS extra FROM ({_S}) UNION ALL SELECT o_orderkey, o_custkey, {_LONG.format('DOUBLE')}, NULL, 'x' FROM ({_B})")(_drift("append_new_columns"))
query("schema_sync_all_columns", f"SELECT o_orderkey, o_custkey, {_LONG.format('BIGINT')} AS o_totalprice, o_orderstatus, CAST(NULL AS VARCHAR) AS extra FROM ({_S}) UNION ALL SELECT o_orderkey, o_custkey, {_LONG.format('BIGINT')}, NULL, 'x' FROM ({_B})")(_drift("sync_all_columns"))


# --- history -------------------------------------------------------------------------------------------------------

CUSTOMER = ["c_custkey", "c_nationkey", "c_mktsegment"]
_V1 = "SELECT c_custkey, c_nationkey, c_mktsegment, TIMESTAMP '2025-01-01' AS at FROM customer WHERE c_mktsegment <> 'BUILDING'"
_V2 = """SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 5 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_nationkey BETWEEN 3 AND 8 THEN TIMESTAMP '2025-06-01' ELSE TIMESTAMP '2025-01-01' END AS at FROM customer WHERE c_mktsegment <> 'MACHINERY'"""


def _customers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select(*CUSTOMER)
    at = F.lit("2025-01-01").cast("timestamp_ntz")
    v1 = c.filter("c_mktsegment <> 'BUILDING'").withColumn("at", at)
    v2 = c.filter("c_mktsegment <> 'MACHINERY'").withColumn("c_mktsegment", F.when(F.col("c_nationkey") < 5, "MOVED").otherwise(F.col("c_mktsegment")))
    return v1, v2.withColumn("at", F.when(F.col("c_nationkey").between(3, 8), F.lit("2025-06-01").cast("timestamp_ntz")).otherwise(at))


def _history_sql(differs: str, gone_closes: bool, marks: bool) -> str:
    close = f"(n.c_custkey IS NOT NULL AND {differs})" + (" OR n.c_custkey IS NULL" if gone_closes else "")
    return f"""WITH o AS ({_V1}), n AS ({_V2})
    SELECT o.c_custkey, o.c_nationkey, o.c_mktsegment, {T1} AS valid_from, CASE WHEN {close} THEN {T2} END AS valid_to, NOT ({close}) AS is_current,
      {"n.c_custkey IS NULL" if marks else "false"} AS is_deleted FROM o LEFT JOIN n USING (c_custkey)
    UNION ALL SELECT n.c_custkey, n.c_nationkey, n.c_mktsegment, {T2}, NULL, true, false FROM n LEFT JOIN o USING (c_custkey) WHERE o.c_custkey IS NULL OR {differs}"""


_SEGMENT, _LATER = "o.c_mktsegment IS DISTINCT FROM n.c_mktsegment", "n.at > o.at"


def _history(name: str, sql: str, **settings: object) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = fresh(spark, name)
        model = Model("snapshot", ["c_custkey"], **settings)
        for rows, now in zip(_customers(spark, sf), (NOW, LATER)):
            t.materialize(rows, model, now=now)
        return t.read().drop("at").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


_history("scd2_check", _history_sql(_SEGMENT, False, False), strategy="check", check_cols=["c_mktsegment"])
_history("scd2_check_all", _history_sql(f"({_SEGMENT} OR o.at <> n.at)", False, False), strategy="check", check_cols="all")
_history("scd2_timestamp", _history_sql(_LATER, False, False), strategy="timestamp", updated_at="at")
_history("scd2_invalidate", _history_sql(_SEGMENT, True, True), strategy="check", check_cols=["c_mktsegment"], hard_deletes="invalidate")
_history("scd2_new_record", _history_sql(_SEGMENT, True, False), strategy="check", check_cols=["c_mktsegment"], hard_deletes="new_record")


# --- changes -------------------------------------------------------------------------------------------------------


@query(
    "cdc_diff",
    f"""WITH o AS ({_V1}), n AS ({_V2})
    SELECT CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, '{{"c_custkey":' || coalesce(n.c_custkey, o.c_custkey) || '}}' AS pk,
      o.c_mktsegment AS before, n.c_mktsegment AS after
    FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR {_SEGMENT} OR o.at <> n.at""",
)
def cdc_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _customers(spark, sf)
    return compute_changes(new, old, ["c_custkey"]).select("op", "pk", F.get_json_object("before_data", "$.c_mktsegment").alias("before"), F.get_json_object("after_data", "$.c_mktsegment").alias("after"))


@query("row_diff", f"WITH o AS ({_V1}), n AS ({_V2}) SELECT n.c_custkey, n.c_mktsegment, CASE WHEN o.c_custkey IS NULL THEN 'new' ELSE 'changed' END AS change FROM n LEFT JOIN o USING (c_custkey) WHERE o.c_custkey IS NULL OR {_SEGMENT}")
def row_diff_query(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _customers(spark, sf)
    return row_diff(new.drop("at", "c_nationkey"), old.drop("at", "c_nationkey"), ["c_custkey"])


def _logged(spark: SparkSession, sf: str) -> Table:
    t = fresh(spark, "logged")
    keys = [Declared("c_custkey", key=True), *[Declared(c) for c in ("c_nationkey", "c_mktsegment")]]
    for rows, now in zip(_customers(spark, sf), (NOW, LATER)):
        t.materialize(rows.drop("at"), Model("table"), keys, now=now, asset="customers", run_id=f"r{now:%m}", track=True)
    return t


_LOG = f"""WITH o AS ({_V1}), n AS ({_V2}) SELECT 'INSERT' AS op, 'r01' AS run_id, count(*) AS events FROM o
UNION ALL SELECT CASE WHEN o.c_custkey IS NULL THEN 'INSERT' WHEN n.c_custkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END, 'r02', count(*)
FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR {_SEGMENT} GROUP BY ALL"""


@query("change_log", _LOG)
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    return _logged(spark, sf).changes().groupBy("op", "run_id").agg(F.count("*").alias("events"))


# --- validation: rule, passed, violations ---------------------------------------------------------------------------


def _rule(name: str, source: str, check: Check, sql: str) -> None:
    @query(f"dq_{name}", f"SELECT '{check.rule}' AS rule, n = 0 AS passed, n AS violations FROM ({sql})")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = validate(table(spark, sf, source), [check])[0]
        n = next((r.metadata[k] for k in ("violations", "null_count", "duplicate_count") if k in r.metadata), 0 if r.passed else 1)
        return spark.createDataFrame([(r.rule, r.passed, n)], "rule string, passed boolean, violations bigint")


def _n(source: str, where: str) -> str:
    return f"SELECT count(*) AS n FROM {source} WHERE {where}"


_rule("not_null", "documents", Check("expect_column_values_to_not_be_null", "lang"), _n("documents", "lang IS NULL"))
_rule("unique", "orders", Check("expect_column_values_to_be_unique", "o_custkey"), "SELECT count(*) - count(DISTINCT o_custkey) AS n FROM orders")
_rule("unique_nulls", "transactions", Check("expect_column_values_to_be_unique", "txn_id"), "SELECT count(*) - count(DISTINCT txn_id) - 1 AS n FROM transactions")
_rule("between", "lineitem", Check("expect_column_values_to_be_between", "l_quantity", arguments={"min": 2, "max": 49}), _n("lineitem", "l_quantity < 2 OR l_quantity > 49"))
_rule("in_set", "documents", Check("expect_column_values_to_be_in_set", "lang", arguments={"allowed": ["en", "de", "fr"]}), _n("documents", "lang IS NULL OR lang NOT IN ('en', 'de', 'fr')"))
_rule("decimal_places", "part", Check("expect_column_values_to_have_decimal_places", "p_retailprice", arguments={"max_decimal_places": 1}), _n("part", "round(p_retailprice, 1) <> p_retailprice"))
_rule("length_equal", "orders", Check("expect_column_value_length_equal_to", "o_orderpriority", arguments={"length": 8}), _n("orders", "length(o_orderpriority) <> 8"))
_rule("length_between", "documents", Check("expect_column_value_length_between", "title", arguments={"min": 8, "max": 15}), _n("documents", "length(title) NOT BETWEEN 8 AND 15"))
_rule("pattern", "part", Check("expect_column_value_pattern_match", "p_name", arguments={"pattern": "(red|blue|hot)"}), _n("part", "NOT regexp_matches(p_name, '^(red|blue|hot)')"))
_rule("datetime_format", "account_file", Check("expect_column_datetime_value_format", "date", arguments={"format": "%Y-%m-%d"}), _n("account_file", "date IS NOT NULL AND NOT regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}')"))
_rule("row_condition", "orders", Check("expect_row_condition_to_be_true", arguments={"expression": "o_totalprice > 400000 and o_orderstatus in ['F', 'P']"}), _n("orders", "o_totalprice > 400000 AND o_orderstatus IN ('F', 'P')"))
_rule("if_then", "lineitem", Check("expect_row_if_then_condition", arguments={"if": "l_returnflag == 'A'", "then": "l_linestatus == 'F' and l_quantity < 40"}), _n("lineitem", "l_returnflag = 'A' AND NOT (l_linestatus = 'F' AND l_quantity < 40)"))
_rule("row_count", "nation", Check("expect_table_row_count_to_be_between", arguments={"min": 1, "max": 24}), "SELECT CASE WHEN count(*) BETWEEN 1 AND 24 THEN 0 ELSE 1 END AS n FROM nation")
_rule("rows_unique", "change_log", Check("expect_table_rows_to_be_unique"), "SELECT (SELECT count(*) FROM change_log) - (SELECT count(*) FROM (SELECT DISTINCT * FROM change_log)) AS n")
_rule("column_count", "region", Check("expect_table_column_count_to_equal", arguments={"expected": 2}), "SELECT CASE WHEN count(*) = 2 THEN 0 ELSE 1 END AS n FROM (DESCRIBE region)")
_rule("column_type", "orders", Check("expect_column_type", "o_orderdate", arguments={"dtype": "date"}), "SELECT CASE WHEN bool_and(o_orderdate = date_trunc('day', o_orderdate)) THEN 0 ELSE 1 END AS n FROM orders")
_rule("plugin", "customer", Check("expect_plugin_validation", arguments={"plugin": "validate_custom_threshold", "args": {"column": "c_acctbal", "threshold": 9000}}), _n("customer", "c_acctbal > 9000"))


@query(
    "dq_one_pass",
    """SELECT * FROM (VALUES ('l_quantity_expect_column_values_to_be_between', (SELECT count(*) FROM lineitem WHERE l_quantity < 1)),
    ('l_returnflag_expect_column_values_to_be_in_set', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))),
    ('l_discount_expect_column_values_to_not_be_null', (SELECT count(*) FROM lineitem WHERE l_discount IS NULL)),
    ('expect_row_condition_to_be_true', (SELECT count(*) FROM lineitem WHERE l_tax > 0.07))) t(name, violations)""",
)
def dq_one_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Four rules by a single scan."""
    checks = [
        Check("expect_column_values_to_be_between", "l_quantity", arguments={"min": 1}),
        Check("expect_column_values_to_be_in_set", "l_returnflag", arguments={"allowed": ["A", "N"]}),
        Check("expect_column_values_to_not_be_null", "l_discount"),
        Check("expect_row_condition_to_be_true", arguments={"expression": "l_tax > 0.07"}),
    ]
    found = validate(table(spark, sf, "lineitem"), checks)
    return spark.createDataFrame([(r.name, r.metadata.get("violations", r.metadata.get("null_count"))) for r in found], "name string, violations bigint")


# --- sources and streams -------------------------------------------------------------------------------------------


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")


_PART = "SELECT p_partkey, p_name, p_retailprice FROM part"


@query("csv_roundtrip", _PART)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    to = scratch(spark, "csv") + "/part.csv"
    _part(spark, sf).withColumn("p_name", F.concat(F.lit('"q", '), "p_name")).write.csv(to, header=True, escape='"')
    return read_file(spark, to).withColumn("p_name", F.replace("p_name", F.lit('"q", '), F.lit(""))).drop("file_name")


_REVIEWS = "SELECT doc_id, nullif(title, '') AS title, nullif(text, '') AS text FROM documents"


@query("csv_line_breaks", _REVIEWS)
def csv_line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with line breaks and quotes inside of fields, written as one file and read in ranges of 64 KB, so records reach over the borders of ranges."""
    to = scratch(spark, "csv") + "/reviews"
    docs = table(spark, sf, "documents").select("doc_id", "title", "text")
    docs.coalesce(1).write.csv(to, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    kept = {"null_if": [""], "infer": False, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return read_csv(spark, to, kept, span=1 << 16).select(F.col("doc_id").cast("long"), "title", "text")


@query("csv_own_headers", _PART)
def csv_own_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one folder whose columns come in different orders."""
    to = scratch(spark, "csv")
    part = _part(spark, sf)
    part.filter("p_partkey % 2 = 0").write.csv(f"{to}/a", header=True)
    part.filter("p_partkey % 2 = 1").select("p_retailprice", "p_partkey", "p_name").write.csv(f"{to}/b", header=True)
    return read_csv(spark, to, {"recursiveFileLookup": "true"}).select("p_partkey", "p_name", "p_retailprice")


@query("csv_named_format", _PART.replace("p_name,", "nullif(p_name, 'red widget') AS p_name,"))
def csv_named_format(spark: SparkSession, sf: str) -> DataFrame:
    """Bars between fields, a line before the header, and a token for null."""
    to = scratch(spark, "csv") + "/part.txt"
    lines = _part(spark, sf).coalesce(1).select(F.concat_ws("|", "p_partkey", "p_name", "p_retailprice").alias("value"), F.lit(2).alias("o"), F.col("p_partkey").alias("k"))
    top = spark.createDataFrame([("written today", 0, 0), ("p_partkey|p_name|p_retailprice", 1, 0)], "value string, o int, k long")
    top.unionByName(lines).coalesce(1).sortWithinPartitions("o", "k").select("value").write.text(to)
    fmt = Format("bars", "csv", {"delimiter": "|", "skip_header": 1, "null_if": ["red widget"]})
    return read_file(spark, to, fmt).drop("file_name")


@query("json_roundtrip", _PART)
def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    to = scratch(spark, "json") + "/part.json"
    _part(spark, sf).write.json(to)
    return read_file(spark, to, Format("lines", "json", {"lines": True})).select("p_partkey", "p_name", "p_retailprice")


@query("file_name_column", "SELECT count(*) AS n, true AS named FROM part")
def file_name_column(spark: SparkSession, sf: str) -> DataFrame:
    return read_file(spark, f"{sf}/part.parquet").agg(F.count("*").alias("n"), F.bool_and(F.col("file_name").endswith(".parquet")).alias("named"))


@query("schema_infer", "SELECT r_regionkey, r_name, r_regionkey / 2.0::DOUBLE AS half, r_regionkey > 2 AS big, TIMESTAMP '2026-01-01' + to_days(r_regionkey) AS day FROM region")
def schema_infer(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as an API gives them: JSON values, typed by what all of a field have in common."""
    rows = table(spark, sf, "region").orderBy("r_regionkey").collect()
    payload = [{"r_regionkey": r[0], "r_name": r[1], "half": r[0] / 2 if r[0] % 2 else r[0] // 2, "big": r[0] > 2, "day": f"2026-01-0{1 + r[0]}"} for r in rows]
    return to_frame(spark, payload).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("file_stream_ingest", "SELECT * FROM part")
def file_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """New files of a folder in micro-batches, each written under its number."""
    landing, to = scratch(spark, "landing"), scratch(spark, "ingested")
    part = table(spark, sf, "part")
    part.repartition(4).write.parquet(landing)
    stream = file_stream(spark, landing, part.schema.simpleString()[7:-1].replace(":", " "), "parquet", "*.parquet", max_files=2)
    ingest(stream, lambda df, i: df.drop("file_name").write.mode("overwrite").parquet(f"{to}/batch={i}"), scratch(spark, "seen"))
    return spark.read.parquet(to).drop("batch")


@query("pipeline_job", "SELECT event_id AS id, upper(event_type) AS kind, value * 2 AS twice FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def pipeline_job(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration end to end: file asset, transforms, typed columns, checks, upsert."""
    from weirflow.operators.tables import TableStore
    from weirflow.plans.pipeline import Runner
    from weirflow.plans.spec import build

    store = TableStore(spark, scratch(spark, "store"))
    config = {
        "assets": [
            {"name": "raw", "type": "file", "source": {"path": f"{sf}/events.parquet"}},
            {
                "name": "stage", "type": "database", "depends_on": ["raw"], "source": {"table": "demo.stage"},
                "model": {"materialization": "incremental", "incremental_strategy": "merge", "unique_key": "id"},
                "transforms": {"pre": 'frame.filter(col("event_type") != "error").order_by("event_id").dedup(["user_id", "event_type"], keep="last")'},
                "columns": [{"name": "id", "dtype": "int", "isKey": True, "expr": 'ref("event_id")'}, {"name": "kind", "dtype": "string", "expr": 'upper(ref("event_type"))', "nullable": False}, {"name": "twice", "dtype": "float", "expr": 'ref("value") * 2'}],
            },
        ],
        "jobs": [{"name": "j", "flow": {"definition": "raw >> stage"}}],
    }
    Runner(spark, build(config), store).run_job("j")
    return store.table("demo.stage").read()
