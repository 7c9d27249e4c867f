"""Queries of the expression and table language, with their SQL. Texts are run as a configuration would give them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.plans.frame import Frame, desc, transform
from weirflow.plans.projection import Declared, Run, project
from weirflow.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def chain(name: str, source: str, text: str, sql: str, columns: str | None = None) -> None:
    """A table-level chain over one table."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, source)
        return transform(df.select(*columns.split()) if columns else df, text).df()

    QUERIES[name], SQL[name] = run, sql


def columns(name: str, source: str, exprs: dict[str, str], sql: str, pre: str | None = None, post: str | None = None, types: dict[str, str] | None = None) -> None:
    """Declared columns over one table."""
    declared = [Declared(n, (types or {}).get(n), e) for n, e in exprs.items()]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return project(table(spark, sf, source), declared, pre, post, Run("run-1", {"team": "core"}, name)).data

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# --- filters -------------------------------------------------------------------------------------------------------

L = "l_orderkey l_partkey l_linenumber l_quantity l_discount"
LS = L.replace(" ", ", ")
chain("filter_compare", "lineitem", 'frame.filter((col("l_quantity") >= 45) & (col("l_discount") < 0.03))', f"SELECT {LS} FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03", L)
chain("filter_and_or_not", "lineitem", 'frame.filter(((col("l_quantity") > 48) | (col("l_discount") == 0.1)) & ~(col("l_linenumber") != 1))', f"SELECT {LS} FROM lineitem WHERE (l_quantity > 48 OR l_discount = 0.1) AND NOT l_linenumber <> 1", L)
chain("filter_is_in", "orders", 'frame.filter(col("o_orderpriority").is_in(["1-URGENT", "5-LOW"]) & ~col("o_orderstatus").is_in(["F"]))', "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus <> 'F'")
chain("filter_between", "part", 'frame.filter(col("p_size").between(10, 20))', "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
chain("filter_col_vs_col", "lineitem", 'frame.filter(col("l_suppkey") > col("l_partkey"))', "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey > l_partkey", "l_orderkey l_partkey l_suppkey")
chain("filter_contains_regex", "part", 'frame.filter(col("p_name").contains("^(red|blue) .*t$"))', "SELECT * FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')")
chain("filter_contains_nocase", "part", 'frame.filter(col("p_type").contains("econ", case=False))', "SELECT * FROM part WHERE regexp_matches(p_type, 'econ', 'i')")
chain("filter_starts_ends", "customer", 'frame.filter(col("c_name").starts_with("Customer#0000001") | col("c_name").ends_with("7"))', "SELECT * FROM customer WHERE starts_with(c_name, 'Customer#0000001') OR suffix(c_name, '7')")
chain("filter_nulls", "documents", 'frame.filter(col("lang").is_null() | (col("rating").is_not_null() & (col("rating") != 5)))', "SELECT doc_id, lang, rating FROM documents WHERE lang IS NULL OR (rating IS NOT NULL AND rating <> 5)", "doc_id lang rating")
chain("filter_not_in_keeps_nulls", "documents", 'frame.filter(~col("lang").is_in(["en", "de"]))', "SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')", "doc_id lang")
chain("filter_contains_null_is_false", "documents", 'frame.filter(~col("title").contains("good", case=False))', "SELECT doc_id, title FROM documents WHERE NOT coalesce(regexp_matches(title, 'good', 'i'), false)", "doc_id title")

# --- columns -------------------------------------------------------------------------------------------------------

chain("select_columns", "part", 'frame.select("p_partkey", "p_brand")', "SELECT p_partkey, p_brand FROM part")
chain("drop_columns", "part", 'frame.drop("p_name", "p_type")', "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
chain("rename_columns", "nation", 'frame.rename({"n_name": "nation", "absent": "x"})', "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation")
columns(
    "project_arithmetic", "lineitem",
    {"l_orderkey": 'ref("l_orderkey")', "l_linenumber": 'ref("l_linenumber")', "net": 'ref("l_extendedprice") * (1 - ref("l_discount"))', "per_unit": 'ref("l_extendedprice") / ref("l_quantity")', "none": 'ref("l_quantity") / (ref("l_linenumber") - ref("l_linenumber"))', "line_mod": 'ref("l_linenumber") % 3', "tag": 'value("x")'},
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS per_unit, CAST(NULL AS DOUBLE) AS none, cast(l_linenumber % 3 AS BIGINT) AS line_mod, 'x' AS tag FROM lineitem",
    types={"line_mod": "int"},
)
columns(
    "when_nested", "orders",
    {"o_orderkey": 'ref("o_orderkey")', "bucket": 'when(ref("o_totalprice") >= 300000, value("LARGE"), when(ref("o_totalprice") >= 100000, value("MEDIUM"), value("SMALL")))', "other": 'when(null_if(ref("o_orderstatus"), "F") == "O", 1, 0)'},
    "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'LARGE' WHEN o_totalprice >= 100000 THEN 'MEDIUM' ELSE 'SMALL' END AS bucket, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS other FROM orders",
)
columns("map_values", "orders", {"o_orderkey": 'ref("o_orderkey")', "status": 'map_values(ref("o_orderstatus"), {"O": "open", "F": "final"}, "other")'}, "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE 'other' END AS status FROM orders")
columns(
    "null_functions", "documents",
    {"doc_id": 'ref("doc_id")', "lang1": 'coalesce(ref("lang"), ref("source"), value("?"))', "rating1": 'fill_na(ref("rating"), 0)', "source1": 'null_if(ref("source"), "shop_web")', "untitled": 'is_null(ref("title"))'},
    "SELECT doc_id, coalesce(lang, source, '?') AS lang1, coalesce(rating, 0) AS rating1, nullif(source, 'shop_web') AS source1, title IS NULL AS untitled FROM documents",
)
columns(
    "str_case_trim", "account_file",
    {"row_id": 'ref("row_id")', "u": 'upper(ref("account_cd"))', "l": 'lower(ref("account_cd"))', "t": 'trim(ref("account_cd"))'},
    "SELECT row_id, upper(account_cd) AS u, lower(account_cd) AS l, regexp_replace(account_cd, '^\\s+|\\s+$', '', 'g') AS t FROM account_file",
)
columns(
    "str_concat", "part",
    {"p_partkey": 'ref("p_partkey")', "label": 'concat(ref("p_brand"), "/", ref("p_size"), "/", ref("p_partkey"))', "plus": 'ref("p_brand") + "-" + ref("p_type")'},
    "SELECT p_partkey, p_brand || '/' || p_size || '/' || p_partkey AS label, p_brand || '-' || p_type AS plus FROM part",
)
columns(
    "str_substr", "customer",
    {"c_custkey": 'ref("c_custkey")', "a": 'substr(ref("c_name"), 0, 4)', "b": 'substr(ref("c_name"), 9, 100)', "c": 'substr(ref("c_name"), -3, 2)', "d": 'substr(ref("c_mktsegment"), -2, 5)'},
    "SELECT c_custkey, c_name[1:4] AS a, c_name[10:109] AS b, c_name[length(c_name)-2:length(c_name)-1] AS c, '' AS d FROM customer",
)
columns("str_replace", "part", {"p_partkey": 'ref("p_partkey")', "r": 'replace_str(ref("p_brand"), "#", ".")'}, "SELECT p_partkey, replace(p_brand, '#', '.') AS r FROM part")
columns(
    "str_split", "part",
    {"p_partkey": 'ref("p_partkey")', "first": 'split(ref("p_name"), " ", 0)', "last": 'split(ref("p_name"), " ", -1)', "none": 'split(ref("p_name"), " ", 7)'},
    "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last, CAST(NULL AS VARCHAR) AS none FROM part",
)
columns("round_half_even", "lineitem", {"l_orderkey": 'ref("l_orderkey")', "l_partkey": 'ref("l_partkey")', "one": 'round_val(ref("l_extendedprice"), 1)', "whole": 'round_val(ref("l_quantity") / 4, decimals=0)'}, "SELECT l_orderkey, l_partkey, round_even(l_extendedprice, 1) AS one, round_even(l_quantity / 4, 0) AS whole FROM lineitem")
columns("abs_floor_ceil", "customer", {"c_custkey": 'ref("c_custkey")', "a": 'abs_val(ref("c_acctbal") - 5000)', "f": 'floor_val(ref("c_acctbal"))', "c": 'ceil_val(ref("c_acctbal"))'}, "SELECT c_custkey, abs(c_acctbal - 5000) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c FROM customer")
columns("cast_numeric", "order_feed", {"rec_id": 'ref("rec_id")', "n": 'to_numeric(split(ref("file_name"), "_", 1))', "none": 'to_numeric(ref("feed"))'}, "SELECT rec_id, try_cast(string_split(file_name, '_')[2] AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS none FROM order_feed")
columns(
    "cast_dates", "account_file",
    {"row_id": 'ref("row_id")', "iso": 'to_date(ref("date"), "%Y-%m-%d")', "slashed": 'to_date(ref("date"), "%Y/%m/%d")', "named": 'to_date(ref("date"), "%d-%b-%Y")'},
    "SELECT row_id, cast(try_strptime(trim(date), '%Y-%m-%d') AS date) AS iso, cast(try_strptime(trim(date), '%Y/%m/%d') AS date) AS slashed, cast(try_strptime(trim(date), '%d-%b-%Y') AS date) AS named FROM account_file",
)
columns("cast_string", "part", {"p_partkey": 'ref("p_partkey")', "size": 'to_string(ref("p_size"))', "price": 'to_string(ref("p_retailprice"))'}, "SELECT p_partkey, cast(p_size AS VARCHAR) AS size, cast(p_retailprice AS VARCHAR) AS price FROM part")
columns("declared_types", "orders", {"o_orderkey": 'ref("o_orderkey")', "price": 'ref("o_totalprice")', "day": 'ref("o_orderdate")', "key_text": 'ref("o_custkey")'}, "SELECT o_orderkey, o_totalprice AS price, cast(o_orderdate AS DATE) AS day, cast(o_custkey AS VARCHAR) AS key_text FROM orders", types={"o_orderkey": "int", "price": "float", "day": "date", "key_text": "string"})
columns(
    "date_diff_units", "cash_balance",
    {"row_id": 'ref("row_id")', "d": 'date_diff(ref("update_timestamp"), ref("ingested_at"))', "h": 'date_diff(ref("ingested_at"), ref("update_timestamp"), "hours")', "s": 'date_diff(ref("ingested_at"), ref("update_timestamp"), unit="seconds")'},
    "SELECT row_id, cast(floor((epoch_us(update_timestamp) - epoch_us(ingested_at)) / 86400e6) AS BIGINT) AS d, (epoch_us(ingested_at) - epoch_us(update_timestamp)) / 3600e6 AS h, (epoch_us(ingested_at) - epoch_us(update_timestamp)) / 1e6 AS s FROM cash_balance",
)
columns("date_add_units", "events", {"event_id": 'ref("event_id")', "a": 'date_add(ref("ts"), 3)', "b": 'date_add(ref("ts"), -90, "minutes")', "c": 'date_add(ref("ts"), ref("user_id"), unit="hours")'}, "SELECT event_id, ts + INTERVAL 3 DAY AS a, ts - INTERVAL 90 MINUTE AS b, ts + to_hours(user_id) AS c FROM events")
columns("date_trunc_periods", "events", {"event_id": 'ref("event_id")', **{p: f'date_trunc(ref("ts"), "{p}")' for p in ("day", "week", "month", "quarter", "year")}}, "SELECT event_id, " + ", ".join(f"cast(date_trunc('{p}', ts) AS TIMESTAMP) AS {p}" for p in ("day", "week", "month", "quarter", "year")) + " FROM events")
columns("extract_parts", "events", {"event_id": 'ref("event_id")', **{f"p_{p}": f'extract_part(ref("ts"), "{p}")' for p in ("year", "quarter", "month", "day", "hour", "minute", "second", "dayofyear", "dayofweek")}}, "SELECT event_id, " + ", ".join(f"cast({p}(ts) AS BIGINT) AS p_{p}" for p in ("year", "quarter", "month", "day", "hour", "minute", "second", "dayofyear")) + ", cast(isodow(ts) - 1 AS BIGINT) AS p_dayofweek FROM events")
columns("hash_key", "orders", {"o_orderkey": 'ref("o_orderkey")', "k": 'hash_key(ref("o_orderkey"), ref("o_orderstatus"), ref("o_custkey"))'}, "SELECT o_orderkey, md5(concat_ws('|', cast(o_orderkey AS VARCHAR), o_orderstatus, cast(o_custkey AS VARCHAR))) AS k FROM orders")
columns("hash_key_of_nulls", "documents", {"doc_id": 'ref("doc_id")', "k": 'hash_key(ref("lang"), ref("rating"))'}, "SELECT doc_id, md5(coalesce(lang, '<NA>') || '|' || coalesce(cast(rating AS VARCHAR), '<NA>')) AS k FROM documents")
columns("agg_broadcast", "events", {"event_id": 'ref("event_id")', "over_mean": 'ref("value") - mean_of(ref("value"))', "share": 'ref("value") / sum_of(ref("value"))', "low": 'min_of(ref("value"))', "high": 'max_of(ref("value"))', "n": 'count_of(ref("value"))'}, "SELECT event_id, value - (SELECT avg(value) FROM events) AS over_mean, value / (SELECT sum(value) FROM events) AS share, (SELECT min(value) FROM events) AS low, (SELECT max(value) FROM events) AS high, (SELECT count(value) FROM events) AS n FROM events")
columns("system_columns", "region", {"r_regionkey": 'ref("r_regionkey")', "run": "context.run.run_id", "asset": "context.asset_key", "team": 'context.run.tags["team"]'}, "SELECT r_regionkey, 'run-1' AS run, 'system_columns' AS asset, 'core' AS team FROM region")

# --- windows -------------------------------------------------------------------------------------------------------

W = "(PARTITION BY {} ORDER BY {} NULLS LAST)"
E0 = {"event_id": 'ref("event_id")'}
columns("win_row_number", "events", {**E0, "n": 'row_number(ref("user_id"), ref("event_id"))'}, f"SELECT event_id, cast(row_number() OVER {W.format('user_id', 'event_id')} AS BIGINT) AS n FROM events")
columns("win_row_number_desc", "orders", {"o_orderkey": 'ref("o_orderkey")', "n": 'row_number([ref("o_custkey"), ref("o_orderstatus")], [desc("o_totalprice"), asc("o_orderkey")])'}, "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS BIGINT) AS n FROM orders")
for _m, _f in (("min", "rank()"), ("dense", "dense_rank()"), ("max", "count(*)"), ("first", "row_number()")):
    _o = "o_orderkey" if _m == "first" else "o_orderdate"
    columns(f"win_rank_{_m}", "orders", {"o_orderkey": 'ref("o_orderkey")', "r": f'rank(ref("o_custkey"), ref("{_o}"), "{_m}")'}, f"SELECT o_orderkey, cast({_f} OVER {W.format('o_custkey', _o)} AS BIGINT) AS r FROM orders")
columns("win_rank_average", "orders", {"o_orderkey": 'ref("o_orderkey")', "r": 'rank(ref("o_orderpriority"), ref("o_orderdate"), "average")'}, f"SELECT o_orderkey, (rank() OVER {W.format('o_orderpriority', 'o_orderdate')} + count(*) OVER {W.format('o_orderpriority', 'o_orderdate')}) / 2.0::DOUBLE AS r FROM orders")
columns("win_lag", "events", {**E0, "v": 'lag(ref("value"), 1, ref("user_id"), ref("event_id"))', "w": 'lag(ref("value"), -2, ref("user_id"), ref("event_id"))'}, f"SELECT event_id, lag(value, 1) OVER {W.format('user_id', 'event_id')} AS v, lead(value, 2) OVER {W.format('user_id', 'event_id')} AS w FROM events")
columns("win_lead", "events", {**E0, "v": 'lead(ref("event_type"), 1, ref("user_id"), ref("event_id"))'}, f"SELECT event_id, lead(event_type, 1) OVER {W.format('user_id', 'event_id')} AS v FROM events")
columns("win_null_keys", "documents", {"doc_id": 'ref("doc_id")', "n": 'row_number(ref("lang"), ref("doc_id"))', "r": 'rank(ref("source"), ref("rating"), "min")'}, "SELECT doc_id, CASE WHEN lang IS NOT NULL THEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) END AS n, CASE WHEN source IS NOT NULL AND rating IS NOT NULL THEN rank() OVER (PARTITION BY source ORDER BY rating NULLS LAST) END AS r FROM documents")

# --- order, duplicates, top ----------------------------------------------------------------------------------------

EV = "event_id user_id event_type value"
EVS = EV.replace(" ", ", ")


def _first(keys: str, order: str, cols: str = EVS, source: str = "events") -> str:
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM {source}) WHERE n = 1"


chain("dedup_first", "events", 'frame.order_by("event_id").dedup(["user_id", "event_type"])', _first("user_id, event_type", "event_id"), EV)
chain("dedup_last", "events", 'frame.order_by("event_id").dedup(["user_id"], keep="last")', _first("user_id", "event_id DESC"), EV)
chain("dedup_none", "orders", 'frame.dedup(["o_custkey", "o_orderstatus", "o_orderpriority"], keep=False)', "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority) AS n FROM orders) WHERE n = 1", "o_orderkey o_custkey o_orderstatus o_orderpriority")
chain("distinct_all", "lineitem", "frame.distinct()", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "l_returnflag l_linestatus l_linenumber")
chain("distinct_subset", "events", 'frame.order_by("event_id").distinct(["event_type"])', _first("event_type", "event_id"), EV)
chain("latest_per_key", "cash_balance", 'frame.order_by(desc("update_timestamp"), desc("row_id")).dedup(["account_cd"], keep="first")', _first("account_cd", "update_timestamp DESC NULLS LAST, row_id DESC", "row_id, account_cd, update_timestamp, amt", "cash_balance"), "row_id account_cd update_timestamp amt")
chain("topk", "orders", 'frame.order_by(desc("o_totalprice"), "o_orderkey").limit(25)', "SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")

# --- groups --------------------------------------------------------------------------------------------------------

chain(
    "group_aggregates", "lineitem",
    'frame.group_by(["l_returnflag", "l_linestatus"]).agg(agg_sum("l_quantity").alias("qty"), agg_count("l_orderkey").alias("n"), agg_mean("l_discount"), agg_min("l_shipdate"), agg_max("l_extendedprice"))',
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(l_orderkey) AS n, avg(l_discount) AS mean_l_discount, min(l_shipdate) AS min_l_shipdate, max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY ALL",
)
chain(
    "group_first_last", "documents",
    'frame.order_by("doc_id").group_by(["source"]).agg(agg_first("lang"), agg_last("lang"), agg_first("doc_id"), agg_count("rating").alias("rated"))',
    "SELECT source, arg_min(lang, doc_id) FILTER (lang IS NOT NULL) AS first_lang, arg_max(lang, doc_id) FILTER (lang IS NOT NULL) AS last_lang, min(doc_id) AS first_doc_id, count(rating) AS rated FROM documents WHERE source IS NOT NULL GROUP BY source",
    "doc_id source lang rating",
)
chain("group_null_keys", "documents", 'frame.group_by(["lang"]).agg(agg_count("doc_id").alias("n"), agg_sum("rating").alias("total"))', "SELECT lang, count(*) AS n, cast(coalesce(sum(rating), 0) AS BIGINT) AS total FROM documents WHERE lang IS NOT NULL GROUP BY lang")
chain("group_having", "orders", 'frame.group_by(["o_custkey"]).agg(agg_count("o_orderkey").alias("n"), agg_max("o_totalprice").alias("top")).filter(col("n") > 12)', "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 12")
columns("post_aggregation", "orders", {"status": 'ref("o_orderstatus")', "price": 'ref("o_totalprice")'}, "SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS high FROM orders WHERE o_totalprice > 1000 GROUP BY ALL", pre='frame.filter(col("o_totalprice") > 1000)', post='frame.group_by(["status"]).agg(agg_count("price").alias("n"), agg_max("price").alias("high"))')

# --- several tables: joins, sets, cubes, event time (extensions) ---------------------------------------------------


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


ENRICHED = [
    Declared("o_orderkey", "int", 'ref("o_orderkey")', key=True),
    Declared("customer", "string", 'coalesce(ref("c_name"), value("unknown"))'),
    Declared("net", "float", 'round_val(ref("l_extendedprice") * (1 - ref("l_discount")), 2)'),
    Declared("size", "string", 'when(ref("l_quantity") >= 40, value("BULK"), when(ref("l_quantity") >= 20, value("MEDIUM"), value("SMALL")))'),
    Declared("key", "string", 'hash_key(ref("o_orderkey"), ref("l_partkey"), ref("l_suppkey"))'),
    Declared("day", "date", 'ref("o_orderdate")'),
]


@query(
    "orders_enriched",
    """SELECT o_orderkey, coalesce(c_name, 'unknown') AS customer, round_even(l_extendedprice * (1 - l_discount), 2) AS net,
    CASE WHEN l_quantity >= 40 THEN 'BULK' WHEN l_quantity >= 20 THEN 'MEDIUM' ELSE 'SMALL' END AS size,
    md5(o_orderkey || '|' || l_partkey || '|' || l_suppkey) AS key, cast(o_orderdate AS DATE) AS day
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND l_quantity > 5""",
)
def orders_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: joins, filter, arithmetic, nested conditions, hash key, typed columns."""
    joined = Frame(table(spark, sf, "lineitem")).join(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    joined = joined.join(table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left").rename({"l_orderkey": "o_orderkey"})
    return project(joined.data, ENRICHED, pre='frame.filter((col("o_orderstatus") != "F") & (col("l_quantity") > 5))').data


for _how, _sql in {
    "inner": "SELECT c_custkey AS k, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "left": "SELECT c_custkey AS k, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "left_semi": "SELECT c_custkey AS k, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
    "left_anti": "SELECT c_custkey AS k, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey",
}.items():

    @query(f"join_{_how}", _sql)
    def _join(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
        o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
        return Frame(c).join(Frame(o), "k", how).data


@query("join_asof", "SELECT p.event_id, p.user_id, v.event_id AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The last view before each purchase: one sort per user over both sides together, no join."""
    e = table(spark, sf, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return Frame(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")).join_asof(views, "user_id", "ts", ["seen"]).drop("ts").data


@query("join_asof_bucketed", SQL["join_asof"])
def join_asof_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The same with each user's time cut into days, as for users with a third of all events."""
    e = table(spark, sf, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return Frame(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")).join_asof(views, "user_id", "ts", ["seen"], bucket_seconds=86_400).drop("ts").data


_BANDS = [(0.0, 1000.0, "small"), (900.0, 50_000.0, "middle"), (50_001.0, 200_000.0, "large"), (150_000.0, 10_000_000.0, "huge")]


@query("join_range", f"SELECT o_orderkey, band FROM orders JOIN (VALUES {', '.join(map(str, _BANDS))}) b(low, high, band) ON o_totalprice BETWEEN low AND high")
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the bands of price that hold them, through bins instead of all pairs."""
    bands = spark.createDataFrame(_BANDS, "low double, high double, band string")
    return Frame(table(spark, sf, "orders").select("o_orderkey", "o_totalprice")).join_range(bands, "o_totalprice", "low", "high", 100_000).select("o_orderkey", "band").data


@query("join_theta", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal")
def join_theta(spark: SparkSession, sf: str) -> DataFrame:
    c = Frame(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return c.join_theta(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("c_acctbal") > F.col("s_acctbal"))).select("c_custkey", "s_suppkey").data


@query("union_all_sources", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def union_all_sources(spark: SparkSession, sf: str) -> DataFrame:
    c = Frame(table(spark, sf, "customer")).rename({"c_custkey": "id", "c_name": "name", "c_nationkey": "nation"}).select("id", "name", "nation")
    s = Frame(table(spark, sf, "supplier")).rename({"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation"}).select("id", "name", "nation")
    return c.union(s).data


for _name, _word in (("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT")):

    @query(f"set_{_name}", f"SELECT c_nationkey AS nation, c_custkey % 50 AS k FROM customer {_word} SELECT s_nationkey, s_suppkey % 50 FROM supplier")
    def _set(spark: SparkSession, sf: str, name: str = _name) -> DataFrame:
        a = Frame(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).alias("k")))
        b = Frame(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).alias("k")))
        return {"union_distinct": lambda: a.union(b, distinct=True), "intersect": lambda: a.intersect(b), "except": lambda: a.except_(b)}[name]().data


for _kind in ("rollup", "cube"):

    @query(_kind, f"SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY {_kind.upper()} (l_returnflag, l_linestatus)")
    def _cubed(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        chain_text = f'frame.{kind}(["l_returnflag", "l_linestatus"]).agg(agg_count("l_orderkey").alias("n"), agg_sum("l_quantity").alias("qty"))'
        return transform(table(spark, sf, "lineitem"), chain_text).data


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    from weirflow.streaming.ingest import tumbling

    return tumbling(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], F.count("*").alias("n")).drop("window_end")


@query("window_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL")
def window_sliding(spark: SparkSession, sf: str) -> DataFrame:
    from weirflow.streaming.ingest import tumbling

    return tumbling(table(spark, sf, "events"), "ts", "1 hour", [], F.count("*").alias("n"), slide="30 minutes").drop("window_end")


@query(
    "window_session",
    "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
)
def window_session(spark: SparkSession, sf: str) -> DataFrame:
    from weirflow.streaming.ingest import sessions

    return sessions(table(spark, sf, "events"), "ts", "6 hours", ["user_id"], F.count("*").alias("n")).drop("session_end")


@query("order_nulls_last", "SELECT doc_id, rating, row_number() OVER (ORDER BY rating DESC NULLS LAST, doc_id) AS position FROM documents")
def order_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with its place in the order: files of the sorted frame in turn, each file's rows by index, so no window gathers the table."""
    ordered = transform(table(spark, sf, "documents").select("doc_id", "rating"), 'frame.order_by(desc("rating"), asc("doc_id"))').df()
    rows = cut(ordered, "ordered").withColumns({"file": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")})
    before, starts = 0, []
    for r in rows.groupBy("file").count().orderBy("file").collect():
        starts.append((r["file"], before))
        before += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "file string, before long"))
    return rows.join(offsets, "file").select("doc_id", "rating", (F.col("before") + F.col("at") + 1).alias("position"))


@query("order_desc_limit_api", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def order_desc_limit_api(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the Python interface."""
    return Frame(table(spark, sf, "part")).order_by(desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice").data
