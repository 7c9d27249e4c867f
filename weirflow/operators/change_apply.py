"""Current state of tables from a log of inserts, updates and deletes, column by column, in SQL.

Every change is spread into its fields. Per record and field the last change that sets it wins
(``max_by`` over the change number), and a field counts only if it was set after the record's latest delete or
replacement. A record lives as long as a field of it lives, or its latest whole row does; the change that gives its state is the
latest of those that set a living field, or wrote the whole row. Both steps aggregate partially before
the shuffle, so a record with a third of all changes shrinks to one row per field and task before it moves.

Defined results:
* rows of one number are one change; a change without number, asset, key or known op is ignored;
* op counts by its first letter in either case; ``after`` that is null or no JSON object sets no field;
* a field set to null is there with a null value; in "patch" mode fields that a change doesn't name stay, and an UPDATE
  that names none changes nothing;
* an empty log gives an empty table; other columns of the log aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The marker row that carries a change itself, besides one row for each field it sets.
_STATE = """
WITH change AS (
  SELECT l.asset, l.id, upper(regexp_extract(l.op, '[A-Za-z]', 0)) AS op,
         array_join(transform(c.keys, k -> element_at(pk_map, k)), '|') AS record_key,
         forall(c.keys, k -> element_at(pk_map, k) IS NOT NULL) AS whole_key,
         after_map
  FROM (SELECT asset, id, op, from_json(pk, 'map<string,string>') AS pk_map, from_json(after, 'map<string,string>') AS after_map FROM {log}) l
  JOIN (SELECT asset, transform(split(unique_key, ','), k -> trim(k)) AS keys FROM {assets}) c ON l.asset = c.asset),
field AS (
  SELECT asset, record_key, id, op, explode(concat(
      array(named_struct('name', CAST(NULL AS STRING), 'value', CAST(NULL AS STRING))),
      CASE WHEN op = 'D' THEN array() ELSE coalesce(transform(map_entries(after_map), e -> named_struct('name', e.key, 'value', e.value)), array()) END)) AS f
  FROM change WHERE id IS NOT NULL AND whole_key AND op IN ('I', 'U', 'D')),
last_set AS (
  SELECT asset, record_key, f.name AS name, max_by(named_struct('value', f.value, 'id', id), id) AS won,
         max(id) FILTER (WHERE op = 'D') AS delete_id, max(id) FILTER (WHERE {resets}) AS reset_id
  FROM field GROUP BY asset, record_key, f.name),
record AS (
  SELECT asset, record_key, max(delete_id) FILTER (WHERE name IS NULL) AS delete_id, max(reset_id) FILTER (WHERE name IS NULL) AS reset_id,
         collect_list(named_struct('name', name, 'value', won.value, 'id', won.id)) FILTER (WHERE name IS NOT NULL) AS fields
  FROM last_set GROUP BY asset, record_key),
living AS (
  SELECT asset, record_key, delete_id, reset_id, filter(fields, f -> f.id >= coalesce(reset_id, f.id) AND f.id > coalesce(delete_id, f.id - 1)) AS fields FROM record)
SELECT asset, record_key, greatest(array_max(transform(fields, f -> f.id)), nullif(reset_id, delete_id)) AS id,
       map_from_entries(array_sort(transform(fields, f -> struct(f.name AS key, f.value AS value)))) AS fields
FROM living WHERE size(fields) > 0 OR reset_id > coalesce(delete_id, reset_id - 1)
"""


def current_state(log: DataFrame, assets: DataFrame, mode: str = "replace") -> DataFrame:
    """asset, record_key, id (the change that gives the state) and fields (map) of every living record.

    log: asset, id, op, pk (JSON), after (JSON). assets: asset, unique_key (names joined by commas); one row per
    asset, a table of settings that doesn't grow with the log. mode "replace": INSERT and UPDATE set the whole row;
    "patch": UPDATE sets the fields it names, INSERT the whole row.
    """
    if mode not in ("replace", "patch"):
        raise ValueError(f"mode must be replace or patch, not {mode}")
    log = log.select("asset", "id", "op", "pk", "after")
    assets = assets.select("asset", "unique_key").filter("unique_key IS NOT NULL").dropDuplicates(["asset"])
    query = _STATE.replace("{resets}", "op IN ('I', 'U', 'D')" if mode == "replace" else "op IN ('I', 'D')")
    return log.sparkSession.sql(query, log=log, assets=assets)
