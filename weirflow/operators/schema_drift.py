"""Schemas that drift between files: path-value maps with raw types, statistics by file, typed columns.

1. Each record is read as a map of field -> (kind, text); nothing is cast yet. Kinds come from the JSON token itself.
2. Kinds are counted by feed, file and field. All changes but renames follow from these counts.
3. A rename is looked for only in files with both new and gone fields, and only these fields of their records are compared.
4. One table: names are brought together along the renames of each feed, each column gets the type that most of its values have, and
   what doesn't cast, or meets another value for the same column in one record, is kept as text and reported, never dropped.

Defined results:
* a payload that is null, no JSON object, or names a field twice has no fields (``typed_table`` reports it as failed);
* rows without feed or file number belong to no file that changes; ``typed_table`` keeps them;
* a file whose number minus 1 isn't there has no changes; files are told by number, in whatever order they came;
* a field with several kinds in one file counts as decimal if all are numbers, else as text;
* repeated records don't matter; an order that has two different texts for a field in one file equals nothing;
* an empty table gives no changes and a table without fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.session import cut

#: Kind of a cell c (type: of the JSON token, text: as it stands there). Lengths come first, expressions only where they can match.
_KIND = """CASE
  WHEN c.type = 'VOID' THEN NULL
  WHEN c.type = 'STRING' THEN CASE
    WHEN length(c.text) = 10 AND c.text RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' THEN 'date'
    WHEN length(c.text) = 19 AND c.text RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$' THEN 'datetime'
    ELSE 'text' END
  WHEN c.type = 'BOOLEAN' THEN 'boolean'
  WHEN startswith(c.type, 'OBJECT') THEN 'object'
  WHEN startswith(c.type, 'ARRAY') THEN 'array'
  WHEN contains(c.text, '.') OR contains(c.text, 'e') OR contains(c.text, 'E') THEN 'decimal'
  ELSE 'whole' END"""

#: More distinct field names than this is no drift of a schema, and the driver won't hold them.
MAX_FIELDS = 20_000


def _cells(text: str, depth: int, prefix: str = "''", level: int = 1) -> str:
    """SQL: the cells (name, type, text) of a JSON object, with those of the objects in it down to ``depth`` levels."""
    b, e, c = f"b{level}", f"e{level}", f"c{level}"
    # the object is bound as the one element of an array: else both parses would be inlined and run once per field
    bound = f"array(named_struct('v', try_cast(try_parse_json({text}) AS map<string,variant>), 'r', from_json({text}, 'map<string,string>')))"
    name = f"{e}.key" if depth == 1 and level == 1 else f"concat({prefix}, replace({e}.key, '.', '\\\\.'))"
    own = f"transform(map_entries({b}.r), {e} -> named_struct('name', {name}, 'type', schema_of_variant({b}.v[{e}.key]), 'text', {e}.value))"
    out = f"transform({bound}, {b} -> CASE WHEN {b}.v IS NOT NULL THEN {own} END)[0]"
    if level == depth:
        return out
    inner = _cells(f"{c}.text", depth, f"concat({c}.name, '.')", level + 1)
    return f"transform(array({out}), x{level} -> concat(x{level}, flatten(transform(filter(x{level}, {c} -> startswith({c}.type, 'OBJECT')), {c} -> coalesce({inner}, array())))))[0]"


def path_values(rows: DataFrame, payload: str, keep: dict[str, str], depth: int = 1) -> DataFrame:
    """The kept columns under new names, and fields: map of field -> struct(kind, text); null if the payload is no object.

    depth: down to how many levels the fields of objects in the record are fields of their own, named by their path (``a.b``; a point
    in a name is escaped).
    """
    kept = [F.col(c).alias(n) for n, c in keep.items()]
    fields = f"map_from_entries(transform({_cells(f'`{payload}`', depth)}, c -> struct(c.name, named_struct('kind', {_KIND}, 'text', c.text))))"
    return rows.select(*kept, F.expr(fields).alias("fields"))


def file_types(records: DataFrame) -> DataFrame:
    """feed, file_no, field, type (null if always null), records, nulls."""
    cells = records.select("feed", "file_no", F.explode("fields").alias("field", "cell"))
    kinds = cells.groupBy("feed", "file_no", "field").agg(F.collect_set("cell.kind").alias("kinds"), F.count("*").alias("records"), F.count_if(F.col("cell.kind").isNull()).alias("nulls"))
    numbers = F.forall("kinds", lambda k: k.isin("whole", "decimal"))
    kind = F.when(F.size("kinds") == 0, F.lit(None)).when(F.size("kinds") == 1, F.element_at("kinds", 1)).when(numbers, "decimal").otherwise("text")
    return kinds.select("feed", "file_no", "field", kind.alias("type"), "records", "nulls")


def _neighbours(records: DataFrame, types: DataFrame) -> DataFrame:
    """types with: first (its file has a file before it, which lacks the field), last (the file behind lacks it), held (type as carried on)."""
    files = records.select("feed", "file_no").distinct()
    by_feed = Window.partitionBy("feed").orderBy("file_no")
    files = files.withColumns({"has_before": F.coalesce(F.lag("file_no").over(by_feed) == F.col("file_no") - 1, F.lit(False)), "has_behind": F.coalesce(F.lead("file_no").over(by_feed) == F.col("file_no") + 1, F.lit(False))})
    by_field = Window.partitionBy("feed", "field").orderBy("file_no")
    t = types.withColumns({"goes_on": F.coalesce(F.lag("file_no").over(by_field) == F.col("file_no") - 1, F.lit(False)), "stays": F.coalesce(F.lead("file_no").over(by_field) == F.col("file_no") + 1, F.lit(False))})
    t = t.withColumn("island", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(by_field))
    island = Window.partitionBy("feed", "field", "island").orderBy("file_no")
    t = t.withColumn("held", F.last("type", ignorenulls=True).over(island)).withColumn("held_before", F.lag("held").over(island))
    return t.join(files, ["feed", "file_no"])


def renames(records: DataFrame, new: DataFrame, gone: DataFrame, order: str) -> DataFrame:
    """feed, file_no, field, old_field. new, gone: feed, file_no (the later file), field.

    What is wanted of which file is written first, so Spark knows how large it is and sends it to the records where it is small; else a
    file with a third of all records is split by the adaptive skew join.
    """
    both = new.groupBy("feed", "file_no").agg(F.collect_set("field").alias("new")).join(gone.groupBy("feed", "file_no").agg(F.collect_set("field").alias("gone")), ["feed", "file_no"])
    sides = F.array(F.struct("file_no", F.lit("new").alias("side"), F.col("new").alias("names")), F.struct((F.col("file_no") - 1).alias("file_no"), F.lit("gone").alias("side"), F.col("gone").alias("names")))
    wanted = cut(both.select("feed", F.col("file_no").alias("pair"), F.explode(sides).alias("s")).select("feed", "pair", "s.*"), "wanted")
    keyed = records.select("feed", "file_no", F.col("fields")[order]["text"].alias("order"), "fields").filter("`order` IS NOT NULL")
    cells = keyed.join(wanted, ["feed", "file_no"]).select("feed", "pair", "order", "side", F.explode("names").alias("field"), "fields").select("feed", "pair", "order", "side", "field", F.col("fields")[F.col("field")]["text"].alias("text"))
    cells = cells.filter("text IS NOT NULL").groupBy("feed", "pair", "order", "side", "field").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    # per order only the few new and gone fields meet
    sides = cells.groupBy("feed", "pair", "order").agg(*[F.collect_list(F.when(F.col("side") == s, F.struct("field", "low", "high"))).alias(s) for s in ("new", "gone")])
    met = sides.select("feed", "pair", F.explode("new").alias("n"), "gone").select("feed", "pair", "n", F.explode("gone").alias("g"))
    equal = (F.col("n.low") == F.col("g.low")) & (F.col("n.high") == F.col("g.high")) & (F.col("n.low") == F.col("n.high"))
    judged = met.groupBy("feed", "pair", F.col("n.field").alias("field"), F.col("g.field").alias("old_field")).agg(F.count_if(~equal).alias("unequal"))
    return judged.filter("unequal = 0").select("feed", F.col("pair").alias("file_no"), "field", "old_field")


def drift_changes(records: DataFrame, order: str) -> DataFrame:
    """feed, file_no, change (added, removed, renamed, retyped), field, old_field ('' but for renamed)."""
    t = cut(_neighbours(records, file_types(records)), "types")
    new = t.filter("has_before AND NOT goes_on").select("feed", "file_no", "field", "type")
    gone = t.filter("has_behind AND NOT stays").select("feed", (F.col("file_no") + 1).alias("file_no"), "field", "held")
    renamed = cut(renames(records, new, gone, order), "renames")
    none = F.lit("")
    added = new.join(renamed, ["feed", "file_no", "field"], "left_anti").select("feed", "file_no", F.lit("added").alias("change"), "field", none.alias("old_field"))
    removed = gone.join(renamed.select("feed", "file_no", F.col("old_field").alias("field")), ["feed", "file_no", "field"], "left_anti").select("feed", "file_no", F.lit("removed").alias("change"), "field", none.alias("old_field"))
    retyped = t.filter("goes_on AND type <> held_before").select("feed", "file_no", "field")
    moved = renamed.join(new, ["feed", "file_no", "field"]).join(gone.withColumnRenamed("field", "old_field"), ["feed", "file_no", "old_field"]).filter("type <> held").select("feed", "file_no", "field").distinct()
    retyped = retyped.unionByName(moved).select("feed", "file_no", F.lit("retyped").alias("change"), "field", none.alias("old_field"))
    return added.unionByName(removed).unionByName(renamed.select("feed", "file_no", F.lit("renamed").alias("change"), "field", "old_field")).unionByName(retyped)


def _weights(types: DataFrame) -> dict[str, int]:
    """Records by field name. Bounded by the number of names, which is checked."""
    counted = types.groupBy("field").agg(F.sum("records").alias("n")).limit(MAX_FIELDS + 1).collect()
    if len(counted) > MAX_FIELDS:
        raise ValueError(f"over {MAX_FIELDS} distinct field names")
    return {r["field"]: r["n"] for r in counted}


def canonical(pairs: list[tuple[str, str]], weight: dict[str, int]) -> dict[str, str]:
    """Each name that renames join -> the heaviest of the names it is joined with."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    best: dict[str, str] = {}
    for f in sorted(root, key=lambda f: (-weight.get(f, 0), f)):
        best.setdefault(find(f), f)
    return {f: best[find(f)] for f in root}


def feed_names(changes: DataFrame, weight: dict[str, int]) -> DataFrame:
    """feed, names (map of the names that the feed's renames join to one of them). A feed of another table, or without renames, has no part in it."""

    def run(key, pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([[key[0], list(canonical(list(zip(pdf["field"], pdf["old_field"])), weight).items())]], columns=["feed", "names"])

    renamed = changes.filter("change = 'renamed'").select("feed", "field", "old_field").distinct()
    kind = changes.schema["feed"].dataType.simpleString()
    named = renamed.groupBy("feed").applyInPandas(run, f"feed {kind}, names array<struct<field: string, name: string>>")
    return cut(named.select("feed", F.map_from_entries("names").alias("names")), "names")


_SQL_TYPE = {"whole": "bigint", "decimal": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp_ntz"}


def typed_table(rows: DataFrame, payload: str, key: str, feed: str, file_no: str, order: str, policy: str = "sync_all_columns") -> DataFrame:
    """key, feed, file_no, one typed column per field (its most frequent name), failed and rest.

    failed: the columns that didn't cast, and the fields whose column another field of the record took already (the one under the
    column's own name goes first, then the names in their order); "*" for a payload without fields. rest: the texts of all of
    these by their own names. A field whose name is taken, if only in another case, gets a trailing underscore.

    policy: "ignore" keeps only fields of the lowest file number, "fail" raises if anything changed, the others keep all.
    """
    cells = cut(path_values(rows, payload, {"_key": key, "feed": feed, "file_no": file_no}), "cells")
    types = cut(file_types(cells), "file_types")
    changes = drift_changes(cells, order)
    if policy == "fail" and changes.limit(1).count():
        raise ValueError("the schema changed between files")
    names = feed_names(changes, _weights(types))
    named = types.join(names, "feed", "left").withColumn("column", F.coalesce(F.col("names")[F.col("field")], "field"))
    first = types.agg(F.min("file_no")).first()[0] if policy == "ignore" else None
    votes: dict[str, dict[str, int]] = {}
    counted = named.groupBy("column", "type").agg(F.sum(F.col("records") - F.col("nulls")).alias("n"), F.min("file_no").alias("first"))
    kept: set[str] = set()
    for r in counted.collect():  # at most the names times the types
        v = votes.setdefault(r["column"], {})
        if r["type"] is not None:
            v[r["type"]] = r["n"]
        if first is None or r["first"] == first:
            kept.add(r["column"])
    # entries of a record in the order of their columns; the first of each column is its value, another text is left over
    entries = "transform(map_entries(fields), e -> named_struct('column', coalesce(names[e.key], e.key), 'other', coalesce(names[e.key], e.key) <> e.key, 'name', e.key, 'text', e.value.text))"
    spread = cells.join(names, "feed", "left").withColumn("_e", F.expr(f"array_sort(filter({entries}, e -> e.text IS NOT NULL))"))
    spread = spread.withColumn("_values", F.expr("map_from_entries(transform(filter(_e, (e, i) -> i = 0 OR get(_e, i - 1).column <> e.column), e -> struct(e.column, e)))"))
    spread = spread.withColumn("_left", F.expr("filter(_e, e -> _values[e.column].text <> e.text)"))

    columns, lost, taken = [], [], {key.lower(), "feed", "file_no", "failed", "rest"}

    def own_name(c: str) -> str:
        """A name of its own: Spark's tables don't tell upper from lower case, and some names are taken."""
        out = c
        while out.lower() in taken:
            out += "_"
        taken.add(out.lower())
        return out

    for c in sorted(kept):
        v = votes[c]
        number = v.get("whole", 0) + v.get("decimal", 0)
        rest = {k: n for k, n in v.items() if k not in ("whole", "decimal")}
        kind = ("decimal" if v.get("decimal") else "whole") if number > max([0, *rest.values()]) else max(rest, key=lambda k: (rest[k], k), default="text")
        cell = F.col("_values")[c]
        value = cell["text"].try_cast(_SQL_TYPE[kind]) if kind in _SQL_TYPE else cell["text"]
        columns.append(value.alias(name := own_name(c)))
        if kind in _SQL_TYPE:
            lost.append(F.when(cell["text"].isNotNull() & value.isNull(), F.struct(F.lit(name).alias("column"), cell["name"].alias("name"), cell["text"].alias("text"))))
    dropped = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<struct<column: string, name: string, text: string>>")
    left = F.expr("transform(_left, e -> named_struct('column', e.name, 'name', e.name, 'text', e.text))")
    if policy == "ignore":
        left = F.filter(left, lambda e: F.coalesce(F.col("names")[e["name"]], e["name"]).isin(sorted(kept)))
    out = spread.select("_key", "feed", "file_no", "fields", *columns, F.concat(dropped, left).alias("_lost"))
    failed = F.when(F.col("fields").isNull(), F.array(F.lit("*"))).otherwise(F.transform("_lost", lambda e: e["column"]))
    rest = F.map_from_entries(F.transform(F.coalesce("_lost", F.array().cast("array<struct<column: string, name: string, text: string>>")), lambda e: F.struct(e["name"], e["text"])))
    shown = [c for c in out.columns if c not in ("_key", "feed", "file_no", "fields", "_lost")]
    return out.select(F.col("_key").alias(key), "feed", "file_no", *[f"`{c}`" for c in shown], failed.alias("failed"), rest.alias("rest"))
