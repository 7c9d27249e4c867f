"""Queries of the data problems kept in the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.attribute_history import snapshot_history, update_history
from weirflow.operators.change_apply import current_state
from weirflow.operators.identifier_index import surplus_copies
from weirflow.operators.load_profile import Watched, coverage, findings, induced, load_dates, profile, value_counts
from weirflow.operators.record_parse import parse_records
from weirflow.operators.schema_drift import drift_changes, file_types, path_values, typed_table
from weirflow.operators.snapshot_diff import snapshot_changes
from weirflow.session import cut, table

TXN_COLUMNS = ["txn_id", "account", "amount", "txn_date", "category"]


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return parse_records(table(spark, sf, "txn_lines"), TXN_COLUMNS)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_records(spark, sf).filter(F.col("reason").isNotNull()).select("line_id", "reason")


def p1_valid(spark: SparkSession, sf: str) -> DataFrame:
    return p1_records(spark, sf).filter(F.col("reason").isNull()).select("line_id", *TXN_COLUMNS)


def p1_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every failed record with the byte at which its fault shows."""
    return p1_records(spark, sf).filter(F.col("reason").isNotNull()).select("line_id", "reason", "error_at")


def _per_sep(make: Callable[[str], str]) -> str:
    arms = " ".join(f"WHEN {name} THEN {make(char)}" for name, char in (("sep = ','", ","), ("sep = '|'", r"\|"), ("sep = ';'", ";")))
    return f"CASE {arms} ELSE {make(chr(92) + 't')} END"


_P1 = f"""
WITH l AS (
  SELECT line_id, coalesce('f' || file_name, 'n') AS file, coalesce(line_no, 0) AS no, regexp_replace(raw_line, '\\r+$', '') AS line
  FROM txn_lines WHERE raw_line IS NOT NULL),
r AS (SELECT * FROM (SELECT *, ltrim(line, chr(65279)) AS bare FROM l) WHERE trim(regexp_replace(bare, '\\s', ' ', 'g')) <> '' AND NOT starts_with(bare, '#')),
h AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY no, line_id) AS k FROM r),
s AS (SELECT file, coalesce(nullif(regexp_extract(bare, '[,|;\\t]'), ''), ',') AS sep,
        list_transform(regexp_split_to_array(bare, '[,|;\\t]'), lambda x: lower(regexp_replace(x, '^[\\s"]+|[\\s"]+$', '', 'g'))) AS names FROM h WHERE k = 1),
j AS (SELECT line_id, line, sep, names FROM h JOIN s USING (file) WHERE k > 1),
q AS (SELECT *,
        {_per_sep(lambda c: f'''regexp_full_match(line, '("([^"]|"")*"|[^"{c}][^"{c}]*|)({c}("([^"]|"")*"|[^"{c}][^"{c}]*|))*')''')} AS sound,
        {_per_sep(lambda c: f'''regexp_extract_all(sep || line, '{c}("([^"]|"")*"|[^"{c}]*)', 1)''')} AS parts FROM j),
f AS (SELECT *, list_transform(parts, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS fields FROM q),
v AS (SELECT line_id, line, sep, parts, sound, len(parts) AS n, fields, names,
        regexp_replace(fields[list_position(names, 'amount')], '^[ \\t]+|[ \\t]+$', '', 'g') AS a,
        regexp_replace(fields[list_position(names, 'txn_date')], '^[ \\t]+|[ \\t]+$', '', 'g') AS d FROM f),
p1 AS (SELECT *, CASE
    WHEN NOT sound THEN 'quoting'
    WHEN n <> 5 THEN 'columns'
    WHEN NOT coalesce(regexp_full_match(a, '[+-]?[0-9]+(\\.[0-9]+)?'), false) THEN 'amount'
    WHEN NOT (d IS NULL OR d IN ('', 'NULL', 'N/A') OR (regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT starts_with(d, '0000') AND try_cast(d AS date) IS NOT NULL)) THEN 'txn_date' END AS reason FROM v)
"""


def _p1_text(name: str) -> str:
    v = f"regexp_replace(fields[list_position(names, '{name}')], '^[ \\t]+|[ \\t]+$', '', 'g')"
    return f"CASE WHEN {v} IN ('', 'NULL', 'N/A', 'null') THEN NULL ELSE {v} END AS {name}"


#: Byte of the k-th field: the raw parts before it and their separators. A quoting fault shows at the end of an open quote, else behind the longest sound start.
_P1_START = "list_sum(list_transform(parts[:{0} - 1], lambda x: strlen(x) + 1))"
_P1_ERRORS = (
    _P1
    + f"""
SELECT line_id, reason, CASE reason
    WHEN 'quoting' THEN CASE WHEN substr(line, length(good) + 1, 1) = '"' AND (good = '' OR right(good, 1) IN (sep, '"')) THEN strlen(line) ELSE strlen(good) END
    WHEN 'columns' THEN CASE WHEN n > 5 THEN {_P1_START.format(6)} ELSE strlen(line) END
    WHEN 'amount' THEN coalesce({_P1_START.format("list_position(names, 'amount')")}, 0)
    ELSE coalesce({_P1_START.format("list_position(names, 'txn_date')")}, 0) END::bigint AS error_at
FROM (SELECT *, {_per_sep(lambda c: f"""regexp_extract(line, '^("([^"]|"")*"|[^"{c}][^"{c}]*|)({c}("([^"]|"")*"|[^"{c}][^"{c}]*|))*')""")} AS good FROM p1 WHERE reason IS NOT NULL)
"""
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_valid": p1_valid, "p1_errors": p1_errors}
SQL: dict[str, str] = {
    "p1_errors": _P1_ERRORS,
    "p1_found": _P1 + "SELECT line_id, reason FROM p1 WHERE reason IS NOT NULL",
    "p1_valid": _P1 + f"SELECT line_id, {_p1_text('txn_id')}, {_p1_text('account')}, cast(a AS double) AS amount, try_cast(d AS date) AS txn_date, {_p1_text('category')} FROM p1 WHERE reason IS NULL",
}


# --- 2: current rows from the change log ---------------------------------------------------------------------------


def p2_state(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "change_log").select(F.col("asset_name").alias("asset"), "id", "op", "pk", F.col("after_data").alias("after"))
    config = table(spark, sf, "asset_config").filter("source_table = 'change_log'")
    return current_state(log, config.select(F.col("asset_name").alias("asset"), "unique_key"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_state(spark, sf).select(F.col("asset").alias("asset_name"), "record_key", "id")


def p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    return p2_state(spark, sf).select(F.col("asset").alias("asset_name"), "record_key", F.explode("fields").alias("field", "value"))


_P2 = """
WITH k AS (SELECT asset_name, string_split(unique_key, ',') AS keys FROM asset_config WHERE source_table = 'change_log'),
c AS (SELECT asset_name, id, upper(left(trim(op), 1)) AS op, after_data, array_to_string(list_transform(keys, lambda x: json_extract_string(pk, '$.' || x)), '|') AS record_key
      FROM change_log JOIN k USING (asset_name)),
w AS (SELECT *, row_number() OVER (PARTITION BY asset_name, record_key ORDER BY id DESC) AS n FROM c),
p2 AS (SELECT * FROM w WHERE n = 1 AND op <> 'D')
"""
QUERIES |= {"p2_found": p2_found, "p2_fields": p2_fields}
SQL |= {
    "p2_found": _P2 + "SELECT asset_name, record_key, id FROM p2",
    "p2_fields": _P2 + "SELECT asset_name, record_key, unnest(json_keys(after_data)) AS field, json_extract_string(after_data, '$.' || unnest(json_keys(after_data))) AS value FROM p2",
}


# --- 3: messages delivered more than once --------------------------------------------------------------------------


def folded(c: str) -> Column:
    """Without regard to letter case and to blanks and tabs at either end."""
    return F.upper(F.regexp_replace(F.col(c), r"^[ \t]+|[ \t]+$", ""))


#: The unambiguous ways to write a day.
DAY_PATTERNS = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd-MMM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyy.MM.dd"]


def calendar_day(c: str) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""), r"(?<=\d)[T ]\d{2}:.*$", "")
    return F.to_date(F.coalesce(*[F.try_to_timestamp(F.initcap(text) if "MMM" in p else text, F.lit(p)) for p in DAY_PATTERNS]))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transactions")
    a = table(spark, sf, "account_file")
    day = F.date_format(calendar_day("date"), "yyyy-MM-dd")
    messages = t.select(F.lit("transactions").alias("source"), folded("txn_id").alias("identifier"), F.col("ingested_at").alias("ord"), "row_id").unionByName(
        a.select(F.lit("account_file").alias("source"), F.concat_ws("|", folded("account_cd"), day).alias("identifier"), F.col("ingested_at").alias("ord"), "row_id").filter(folded("account_cd").isNotNull() & day.isNotNull())
    )
    return surplus_copies(messages).select(F.col("source").alias("source_table"), "row_id")


_FOLD = "upper(regexp_replace({}, '^[ \\t]+|[ \\t]+$', '', 'g'))"
_P3 = f"""
WITH m AS (
  SELECT 'transactions' AS source_table, row_id, ingested_at, {_FOLD.format("txn_id")} AS k, 'x' AS d FROM transactions
  UNION ALL
  SELECT 'account_file', row_id, ingested_at, {_FOLD.format("account_cd")},
    cast(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%Y/%m/%d'), try_strptime(s, '%Y%m%d'), try_strptime(s, '%d-%b-%Y')) AS date)::varchar
  FROM (SELECT *, regexp_replace(trim(date, ' ' || chr(9)), 'T.*$', '') AS s FROM account_file)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_table, k, d ORDER BY ingested_at NULLS LAST, row_id) AS n FROM m WHERE k IS NOT NULL AND d IS NOT NULL)
SELECT source_table, row_id FROM r WHERE n > 1
"""
QUERIES |= {"p3_found": p3_found}
SQL |= {"p3_found": _P3}


# --- 4 and 5: changes between snapshots, and the history of records ------------------------------------------------


def settings(spark: SparkSession, sf: str, asset: str) -> dict:
    """Settings of one asset, lists as lists."""
    r = table(spark, sf, "asset_config").filter(F.col("asset_name") == asset).first().asDict()
    return {k: [x.strip() for x in v.split(",")] if k in ("unique_key", "check_cols") and v else v for k, v in r.items()}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for asset, at in (("customers_dim", "snapshot_dt"), ("positions_dim", "as_of_date")):
        c = settings(spark, sf, asset)
        found = snapshot_changes(table(spark, sf, c["source_table"]), c["unique_key"], at, c["check_cols"], c["updated_at"])
        parts.append(found.select(F.lit(asset).alias("asset_name"), F.date_format("snapshot_dt", "yyyy-MM-dd").alias("snapshot_dt"), "record_key", "change"))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    c = settings(spark, sf, "customers_dim")
    one = snapshot_history(table(spark, sf, c["source_table"]), c["unique_key"], "snapshot_dt", c["check_cols"], c["updated_at"])
    b = settings(spark, sf, "cash_balance_dim")
    two = update_history(table(spark, sf, b["source_table"]), b["unique_key"], b["updated_at"], b["check_cols"], "row_id")

    def texts(df: DataFrame, asset: str, pattern: str) -> DataFrame:
        return df.select(F.lit(asset).alias("asset_name"), "record_key", *[F.coalesce(F.date_format(x, pattern), F.lit("")).alias(x) for x in ("valid_from", "valid_to")])

    return texts(one, "customers_dim", "yyyy-MM-dd").unionByName(texts(two, "cash_balance_dim", "yyyy-MM-dd HH:mm:ss"))


def _p4(asset: str, src: str, key: str, at: str, order: str, differs: str) -> str:
    return f"""
  SELECT '{asset}' AS asset_name, strftime(d.dt, '%Y-%m-%d') AS snapshot_dt, coalesce(n.k, o.k) AS record_key,
    CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT DISTINCT {at} AS dt, dense_rank() OVER (ORDER BY {at}) AS i FROM {src}) d
  JOIN (SELECT * FROM (SELECT *, {key} AS k, dense_rank() OVER (ORDER BY {at}) AS i, row_number() OVER (PARTITION BY {key}, {at} ORDER BY {order}) AS r FROM {src}) WHERE r = 1) n ON n.i = d.i
  FULL JOIN (SELECT * FROM (SELECT *, {key} AS k, dense_rank() OVER (ORDER BY {at}) AS i, row_number() OVER (PARTITION BY {key}, {at} ORDER BY {order}) AS r FROM {src}) WHERE r = 1) o
    ON o.k = n.k AND o.i = n.i - 1
  WHERE d.i > 1 AND n.k IS NOT NULL AND (o.k IS NULL OR {differs})
  UNION ALL
  SELECT '{asset}', strftime(d.dt, '%Y-%m-%d'), o.k, 'removed'
  FROM (SELECT DISTINCT {key} AS k, dense_rank() OVER (ORDER BY {at}) AS i FROM {src}) o
  JOIN (SELECT DISTINCT {at} AS dt, dense_rank() OVER (ORDER BY {at}) AS i FROM {src}) d ON d.i = o.i + 1
  ANTI JOIN (SELECT DISTINCT {key} AS k, dense_rank() OVER (ORDER BY {at}) AS i FROM {src}) n ON n.k = o.k AND n.i = d.i
"""


_CUST, _PORT = _FOLD.format("customer_id"), f"{_FOLD.format('portfolio_id')} || '|' || {_FOLD.format('instrument')}"
_P4 = (
    _p4("customers_dim", "customer_snap", _CUST, "snapshot_dt", "updated_at DESC NULLS LAST", "(o.email, o.tier, o.region) IS DISTINCT FROM (n.email, n.tier, n.region)")
    + " UNION ALL "
    + _p4("positions_dim", "positions", _PORT, "as_of_date", "quantity", "(o.quantity, o.market_value) IS DISTINCT FROM (n.quantity, n.market_value)")
)
_P5 = f"""
WITH s AS (SELECT *, {_CUST} AS k, dense_rank() OVER (ORDER BY snapshot_dt) AS i, row_number() OVER (PARTITION BY {_CUST}, snapshot_dt ORDER BY updated_at DESC NULLS LAST) AS r FROM customer_snap),
u AS (SELECT k, snapshot_dt, i, coalesce('v' || email, '-') || chr(31) || coalesce('v' || tier, '-') || chr(31) || coalesce('v' || region, '-') AS h FROM s WHERE r = 1),
g AS (SELECT *, i - row_number() OVER (PARTITION BY k, h ORDER BY i) AS run FROM u),
v AS (SELECT k, min(snapshot_dt) AS f, max(i) AS e FROM g GROUP BY k, h, run),
d AS (SELECT DISTINCT snapshot_dt, i FROM s),
b AS (SELECT {_FOLD.format("account_cd")} AS k, update_timestamp AS t, arg_max(coalesce(cast(amt AS varchar), '-') || '|' || coalesce(ccy, '-'), row_id) AS h
      FROM cash_balance WHERE update_timestamp IS NOT NULL GROUP BY ALL),
c AS (SELECT *, lag(h) OVER (PARTITION BY k ORDER BY t) AS p FROM b),
w AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS n FROM c WHERE p IS NULL OR p <> h)
SELECT 'customers_dim' AS asset_name, k AS record_key, strftime(f, '%Y-%m-%d') AS valid_from, coalesce(strftime(d.snapshot_dt, '%Y-%m-%d'), '') AS valid_to FROM v LEFT JOIN d ON d.i = v.e + 1
UNION ALL SELECT 'cash_balance_dim', k, strftime(t, '%Y-%m-%d %H:%M:%S'), coalesce(strftime(n, '%Y-%m-%d %H:%M:%S'), '') FROM w
"""
QUERIES |= {"p4_found": p4_found, "p5_found": p5_found}
SQL |= {"p4_found": _P4, "p5_found": _P5}


# --- 6: schemas that drift between files ---------------------------------------------------------------------------


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    return path_values(table(spark, sf, "order_feed"), "payload", {"feed": "feed", "file_no": "file_no"})


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift_changes(cut(p6_records(spark, sf), "paths"), "order_id")


def p6_types(spark: SparkSession, sf: str) -> DataFrame:
    return file_types(p6_records(spark, sf))


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Types by file of all paths, those inside of objects too."""
    return file_types(path_values(table(spark, sf, "order_feed"), "payload", {"feed": "feed", "file_no": "file_no"}, depth=3))


def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    policy = settings(spark, sf, "orders_raw")["on_schema_change"]
    out = typed_table(table(spark, sf, "order_feed"), "payload", "rec_id", "feed", "file_no", "order_id", policy)
    left = F.array_join(F.transform(F.array_sort(F.map_entries("rest")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return out.withColumns({"failed": F.array_join(F.array_sort("failed"), ","), "rest": left})


_P6 = """
WITH c AS (SELECT feed, file_no, payload, unnest(json_keys(payload)) AS field FROM order_feed),
e AS (SELECT feed, file_no, field, json_extract_string(payload, '$.order_id') AS ord, json_type(payload, '$."' || field || '"') AS j, json_extract_string(payload, '$."' || field || '"') AS text,
        json_extract(payload, '$."' || field || '"')::varchar AS raw FROM c),
k AS (SELECT feed, file_no, field, ord, text, CASE
        WHEN j = 'NULL' THEN NULL WHEN j = 'BOOLEAN' THEN 'boolean' WHEN j = 'OBJECT' THEN 'object' WHEN j = 'ARRAY' THEN 'array'
        WHEN j <> 'VARCHAR' THEN CASE WHEN regexp_matches(raw, '[.eE]') THEN 'decimal' ELSE 'whole' END
        WHEN regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date'
        WHEN regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'datetime' ELSE 'text' END AS kind FROM e),
t AS (SELECT feed, file_no, field, CASE WHEN count(DISTINCT kind) < 2 THEN max(kind) WHEN bool_and(kind IN ('whole', 'decimal')) THEN 'decimal' ELSE 'text' END AS type,
        count(*) AS records, count(*) - count(kind) AS nulls FROM k GROUP BY ALL)
"""
_P6_FOUND = (
    _P6
    + """,
f AS (SELECT DISTINCT feed, file_no FROM t),
n AS (SELECT t.* FROM t JOIN f ON f.feed = t.feed AND f.file_no = t.file_no - 1 ANTI JOIN t o ON o.feed = t.feed AND o.file_no = t.file_no - 1 AND o.field = t.field),
g AS (SELECT t.feed, t.file_no + 1 AS file_no, t.field FROM t JOIN f ON f.feed = t.feed AND f.file_no = t.file_no + 1 ANTI JOIN t o ON o.feed = t.feed AND o.file_no = t.file_no + 1 AND o.field = t.field),
r AS (SELECT n.feed, n.file_no, n.field, g.field AS old_field FROM n JOIN g USING (feed, file_no)
      JOIN k a ON a.feed = n.feed AND a.file_no = n.file_no AND a.field = n.field AND a.text IS NOT NULL
      JOIN k b ON b.feed = g.feed AND b.file_no = g.file_no - 1 AND b.field = g.field AND b.ord = a.ord AND b.text IS NOT NULL
      GROUP BY ALL HAVING bool_and(a.text = b.text)),
held AS (SELECT t.*, (SELECT arg_max(p.type, p.file_no) FROM t p WHERE p.feed = t.feed AND p.field = t.field AND p.file_no <= t.file_no AND p.type IS NOT NULL
        AND (SELECT count(*) FROM t q WHERE q.feed = t.feed AND q.field = t.field AND q.file_no BETWEEN p.file_no AND t.file_no) = t.file_no - p.file_no + 1) AS h FROM t)
SELECT feed, file_no, 'added' AS change, field, '' AS old_field FROM n ANTI JOIN r USING (feed, file_no, field)
UNION ALL SELECT g.feed, g.file_no, 'removed', g.field, '' FROM g ANTI JOIN r ON r.feed = g.feed AND r.file_no = g.file_no AND r.old_field = g.field
UNION ALL SELECT feed, file_no, 'renamed', field, old_field FROM r
UNION ALL SELECT t.feed, t.file_no, 'retyped', t.field, '' FROM t JOIN held h ON h.feed = t.feed AND h.file_no = t.file_no - 1 AND h.field = t.field WHERE t.type <> h.h
UNION ALL SELECT DISTINCT r.feed, r.file_no, 'retyped', r.field, '' FROM r JOIN t USING (feed, file_no, field) JOIN held h ON h.feed = r.feed AND h.file_no = r.file_no - 1 AND h.field = r.old_field WHERE t.type <> h.h
"""
)
_P6_COLUMNS = {
    "agent_code": "", "amount": "DOUBLE", "currency": "", "customer_id": "", "customer_note": "", "depot": "", "is_gift": "BOOLEAN", "loyalty_points": "BIGINT", "order_date": "DATE", "order_id": "", "packing": "",
    "product_name": "", "product_sku": "", "promo_rate": "DOUBLE", "quantity": "DOUBLE", "sales_channel": "", "ship_by": "DATE", "status": "", "unit_price": "DOUBLE",
}


def _p6_cast(c: str) -> str:
    v = f"max(text) FILTER (col = '{c}' AND first)"
    return f"CASE WHEN regexp_matches({v}, '^[0-9]{{4}}-') THEN try_cast(substr({v}, 1, 10) AS DATE) END" if _P6_COLUMNS[c] == "DATE" else f"try_cast({v} AS {_P6_COLUMNS[c]})" if _P6_COLUMNS[c] else v


_P6_TABLE = _P6_FOUND.split("held AS (")[0] + f"""
w AS (SELECT field, sum(records) AS records FROM t GROUP BY ALL),
m AS (SELECT feed, old_field AS low, field AS name FROM r UNION SELECT feed, field, old_field FROM r UNION SELECT feed, field, field FROM r UNION SELECT feed, old_field, old_field FROM r
      UNION SELECT a.feed, a.field, b.field FROM r a JOIN r b ON a.feed = b.feed AND a.old_field = b.old_field),
canon AS (SELECT feed, m.low AS field, arg_max(name, records) AS col FROM m JOIN w ON w.field = m.name GROUP BY ALL),
x AS (SELECT o.rec_id, o.feed, o.file_no, j.field, j.text FROM order_feed o LEFT JOIN (
      SELECT rec_id, field, json_extract_string(payload, '$."' || field || '"') AS text FROM (SELECT rec_id, payload, unnest(json_keys(payload)) AS field FROM order_feed)) j ON j.rec_id = o.rec_id AND j.text IS NOT NULL),
y AS (SELECT x.*, coalesce(c.col, x.field) AS col, row_number() OVER (PARTITION BY rec_id, coalesce(c.col, x.field) ORDER BY x.field <> coalesce(c.col, x.field), x.field) = 1 AS first FROM x LEFT JOIN canon c ON c.feed = x.feed AND c.field = x.field),
z AS (SELECT *, first_value(text) OVER (PARTITION BY rec_id, col ORDER BY NOT first) AS won FROM y),
v AS (SELECT rec_id, feed, file_no, {", ".join(f"{_p6_cast(c)} AS {c}" for c in _P6_COLUMNS)} FROM y GROUP BY ALL),
b AS (SELECT z.rec_id, z.field, z.text, CASE WHEN NOT first THEN z.field ELSE z.col END AS shown, NOT first AND text <> won OR first AND ({" OR ".join(f"z.col = '{c}' AND v.{c} IS NULL" for c, k in _P6_COLUMNS.items() if k)}) AS bad FROM z JOIN v USING (rec_id))
SELECT v.*, coalesce(string_agg(shown, ',' ORDER BY shown) FILTER (bad), '') AS failed, coalesce(string_agg(b.field || '=' || b.text, chr(10) ORDER BY b.field) FILTER (bad), '') AS rest
FROM v LEFT JOIN b USING (rec_id) GROUP BY ALL
"""
#: The same over paths: the cells of the record, and of the objects in it.
_P6_PATHS = _P6.replace("WITH c AS (SELECT feed, file_no, payload, unnest(json_keys(payload)) AS field FROM order_feed)", """WITH c0 AS (SELECT feed, file_no, payload, unnest(json_keys(payload)) AS field FROM order_feed),
c1 AS (SELECT feed, file_no, '{"x":' || json_extract(payload, '$."' || field || '"')::varchar || '}' AS inner_, field FROM c0 WHERE json_type(payload, '$."' || field || '"') = 'OBJECT'),
c2 AS (SELECT feed, file_no, json_extract(inner_, '$.x')::varchar AS payload, unnest(json_keys(json_extract(inner_, '$.x'))) AS own, field FROM c1),
c AS (SELECT feed, file_no, payload, field, field AS path FROM c0 UNION ALL SELECT feed, file_no, payload, own, field || '.' || own FROM c2)""").replace("SELECT feed, file_no, field, json_extract_string(payload, '$.order_id') AS ord", "SELECT feed, file_no, path AS shown, json_extract_string(payload, '$.order_id') AS ord").replace("k AS (SELECT feed, file_no, field, ord", "k AS (SELECT feed, file_no, shown AS field, ord")
SQL |= {"p6_table": _P6_TABLE, "p6_paths": _P6_PATHS + "SELECT * FROM t"}
QUERIES |= {"p6_found": p6_found, "p6_types": p6_types, "p6_paths": p6_paths, "p6_table": p6_table}
SQL |= {"p6_found": _P6_FOUND, "p6_types": _P6 + "SELECT * FROM t"}


# --- 7: column profiles of loads -----------------------------------------------------------------------------------

LOAD_NAME = "^transactions_(.+)_([0-9]{4}-[0-9]{2}-[0-9]{2})[.]csv$"
WATCHED = [
    Watched("amount", "number", 0, 1_000_000),
    Watched("txn_date", "day", 0, 60),
    Watched("category", "text"),
]


def p7_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, list[Watched]]:
    counts = cut(value_counts(table(spark, sf, "transactions"), "file_name", WATCHED), "counts")
    loads = cut(load_dates(counts, LOAD_NAME), "loads")
    columns, shares = induced(counts, WATCHED)
    return counts, loads, cut(profile(counts, loads, columns, shares), "profile"), columns


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    counts, loads, stats, columns = p7_parts(spark, sf)
    return findings(counts, loads, stats, columns).select(F.col("load").alias("file_name"), F.col("column").alias("column_name"), "finding")


def p7_profile(spark: SparkSession, sf: str) -> DataFrame:
    stats = p7_parts(spark, sf)[2]
    return stats.select(F.col("load").alias("file_name"), F.col("column").alias("column_name"), "n", "nulls", F.col("distinct").alias("n_distinct"), "out_of_range", "uncovered", "low", "high", "median")


def p7_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each load the expressions of its columns cover, against the load before."""
    _, loads, stats, _ = p7_parts(spark, sf)
    return coverage(stats, loads).withColumnsRenamed({"load": "file_name", "column": "column_name"})


def p7_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """The induced expressions, the narrowest of each column first (no); the rows and loads that each describes, and whether it is part of a typical load."""
    columns, shares = induced(value_counts(table(spark, sf, "transactions"), "file_name", WATCHED), WATCHED)
    found = [(w.name, i, e.pattern, i in w.typical) for w in columns for i, e in enumerate(w.expressions)]
    named = spark.createDataFrame(found, "column_name string, no int, expression string, typical boolean")
    held = shares.groupBy(F.col("column").alias("column_name"), F.col("expression").alias("no")).agg(F.sum("n").alias("n_rows"), F.count_distinct("lk").alias("n_loads"))
    return named.join(held, ["column_name", "no"], "left").fillna(0, ["n_rows", "n_loads"])


_P7 = """
WITH t AS (SELECT file_name AS f, regexp_extract(file_name, '^transactions_(.+)_([0-9-]{10})[.]csv$', 1) AS branch, cast(regexp_extract(file_name, '^transactions_(.+)_([0-9-]{10})[.]csv$', 2) AS date) AS d, amount, txn_date, category FROM transactions),
s AS (
  SELECT f, 'amount' AS c, count(*) AS n, count(*) - count(amount) AS nulls, count(DISTINCT amount) AS dist, count(*) FILTER (amount < 0 OR amount > 1000000) AS oor, count(*) FILTER (amount < 0 OR amount >= 1e7 OR (amount > 0 AND amount < 0.001)) AS broken,
    min(amount) AS low, max(amount) AS high, median(amount) AS med FROM t GROUP BY f
  UNION ALL
  SELECT f, 'txn_date', count(*), count(*) - count(txn_date), count(DISTINCT txn_date), count(*) FILTER (d - txn_date < 0 OR d - txn_date > 60), 0,
    min(cast(d - txn_date AS double)), max(cast(d - txn_date AS double)), median(d - txn_date) FROM t GROUP BY f
  UNION ALL
  SELECT f, 'category', count(*), count(*) - count(category), count(DISTINCT category), 0, count(*) FILTER (NOT regexp_full_match(category, '[a-z_]+')), NULL, NULL, NULL FROM t GROUP BY f),
l AS (SELECT f, lag(f) OVER (PARTITION BY branch ORDER BY d) AS p FROM (SELECT DISTINCT f, branch, d FROM t)),
x AS (SELECT s.*, b.n AS pn, b.nulls AS pnulls, b.dist AS pdist, b.med AS pmed FROM s JOIN l USING (f) LEFT JOIN s b ON b.f = l.p AND b.c = s.c),
v AS (SELECT f, category, count(*) AS n, sum(count(*)) OVER (PARTITION BY f) AS total FROM t WHERE category IS NOT NULL GROUP BY f, category),
tv AS (SELECT f, sum(abs(q)) / 2.0 AS d FROM (
    SELECT f, category, sum(q) AS q FROM (
      SELECT v.f, category, cast(n AS double) / total AS q FROM v JOIN l ON l.f = v.f AND l.p IN (SELECT f FROM v)
      UNION ALL SELECT l.f, category, -cast(n AS double) / total FROM v JOIN l ON l.p = v.f AND l.f IN (SELECT f FROM v)) GROUP BY ALL) GROUP BY f)
"""
_P7_FOUND = (
    _P7
    + """
SELECT f AS file_name, c AS column_name, 'range' AS finding FROM s WHERE oor > 0.04 * (n - nulls)
UNION ALL SELECT f, c, 'pattern' FROM s WHERE c = 'category' AND broken > 0.04 * (n - nulls)
UNION ALL SELECT f, c, 'null_rate' FROM x WHERE abs(nulls / n - pnulls / pn) > 0.12
UNION ALL SELECT f, c, 'distinct' FROM x WHERE dist > 2 * pdist OR pdist > 2 * dist
UNION ALL SELECT f, c, 'shift' FROM x WHERE (c = 'amount' AND (med > 3 * pmed OR pmed > 3 * med)) OR (c = 'txn_date' AND abs(med - pmed) > 5)
UNION ALL SELECT f, 'category', 'shift' FROM tv WHERE d > 0.35
"""
)
QUERIES |= {"p7_found": p7_found, "p7_profile": p7_profile, "p7_coverage": p7_coverage, "p7_expressions": p7_expressions}
#: What the method finds on the test tables; SQL can't induce it, but says what each expression describes.
_P7_INDUCED = {
    "amount": [r"[\-]+[0-9]+[\.]+[0-9]+", r"[\.0-9]+", r"[0-9]+[\.]+[0-9]+[A-Z]+[0-9]+"],
    "txn_date": [r"[\-0-9]+"],
    "category": [r"[ ]+[a-z]+", r"[A-Z]+[0-9]+", r"[a-z]+[ ]+", r"[a-z]+[\?]+", r"[a-z]+", r"[A-Z_]+", r"[_a-z]+", r"[ _a-z]+", r"[/_a-z]+", r"[\-\?a-z]+", r"[0-9_a-z]+", r"[A-Z_a-z]+"],
}
_P7_EXPRESSIONS = f"""
WITH e(c, no, x) AS (VALUES {", ".join(f"('{c}', {i}, '{x}')" for c, xs in _P7_INDUCED.items() for i, x in enumerate(xs))}),
t AS (
  SELECT file_name AS f, 'amount' AS c, CASE WHEN abs(amount) >= 1e7 THEN '1.0E7' ELSE cast(amount AS varchar) END AS v FROM transactions WHERE amount IS NOT NULL
  UNION ALL SELECT file_name, 'txn_date', cast(txn_date AS varchar) FROM transactions WHERE txn_date IS NOT NULL
  UNION ALL SELECT file_name, 'category', category FROM transactions WHERE category IS NOT NULL),
d AS (SELECT c, v, min(no) AS no FROM (SELECT DISTINCT c, v FROM t) JOIN e USING (c) WHERE regexp_full_match(v, x) GROUP BY ALL),
m AS (SELECT f, c, coalesce(no, -1) AS no, count(*) AS n FROM t LEFT JOIN d USING (c, v) GROUP BY ALL),
h AS (SELECT f, c, sum(n) AS held FROM m GROUP BY ALL),
s AS (SELECT e.c, e.no, median(coalesce(m.n, 0) / h.held) AS share FROM e JOIN h ON h.c = e.c LEFT JOIN m ON m.f = h.f AND m.c = e.c AND m.no = e.no GROUP BY ALL),
k AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY c ORDER BY share DESC, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM s)
SELECT c AS column_name, no, x AS expression, share > 0 AND upto < 0.96 AS typical, coalesce(sum(n), 0)::bigint AS n_rows, count(DISTINCT f) AS n_loads
FROM e JOIN k USING (c, no) LEFT JOIN m USING (c, no) GROUP BY ALL
"""
SQL |= {
    "p7_expressions": _P7_EXPRESSIONS,
    "p7_coverage": _P7 + """SELECT s.f AS file_name, s.c AS column_name, (s.n - s.nulls - s.broken) / nullif(s.n - s.nulls, 0) AS covered, (b.n - b.nulls - b.broken) / nullif(b.n - b.nulls, 0) AS covered_before,
      ((s.n - s.nulls - s.broken) / nullif(s.n - s.nulls, 0)) - ((b.n - b.nulls - b.broken) / nullif(b.n - b.nulls, 0)) AS change FROM s JOIN l USING (f) LEFT JOIN s b ON b.f = l.p AND b.c = s.c""",
    "p7_found": _P7_FOUND,
    "p7_profile": _P7 + "SELECT f AS file_name, c AS column_name, n, nulls, dist AS n_distinct, oor AS out_of_range, broken AS uncovered, cast(low AS double) AS low, cast(high AS double) AS high, cast(med AS double) AS median FROM s",
}
