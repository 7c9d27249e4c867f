"""Queries of the text problems, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.overlap import shared_runs
from weirflow.llm.packing import TIERS, pack, token_counts
from weirflow.llm.prose import STATISTICS, outliers
from weirflow.session import table


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    sizes = token_counts(table(spark, sf, "documents"), "doc_id", "text")
    return pack(sizes).withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, pieces, unused space and cost of each container, the tokens that lie in windows of each context, and the cost of its step group."""
    placed = p8_packing(spark, sf)
    per_tier = [F.sum(F.when(F.col("tier") == t, F.col("tokens")).otherwise(0)).alias(f"in_{t}") for t in TIERS]
    by = placed.groupBy("step_group", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum(F.col("tokens") * F.col("tokens")).alias("cost"), *per_tier)
    groups = by.groupBy("step_group").agg(F.sum("cost").alias("group_cost"))
    return by.join(groups, "step_group").withColumn("unused", 2048 - F.col("tokens"))


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    items = table(spark, sf, "eval_items").select(F.col("eval_id").alias("key"), "text")
    return shared_runs(docs, items).select(F.col("key").alias("doc_id"), F.col("item").alias("eval_id"), "start", "length")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_spans(spark, sf).select("doc_id", "eval_id")


def common_words(spark: SparkSession, sf: str) -> dict[str, frozenset[str]]:
    common: dict[str, set] = {}
    for r in table(spark, sf, "common_words").filter("lang IS NOT NULL AND word IS NOT NULL").collect():  # a fixed list of some hundred words
        common.setdefault(r["lang"], set()).add(r["word"].lower())
    return {k: frozenset(v) for k, v in common.items()}


def p10_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return outliers(table(spark, sf, "documents"), common_words(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_outliers(spark, sf).filter("kind IS NOT NULL").select(F.col("key").alias("doc_id"), "kind")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Every text's statistics, its distance from prose, and what each statistic adds to it."""
    d = p10_outliers(spark, sf)
    names = [F.col("stats")[i].alias(n) for i, n in enumerate(STATISTICS)]
    parts = [F.col("shares")[i].alias(f"{n}_part") for i, n in enumerate(STATISTICS)]
    return d.select(F.col("key").alias("doc_id"), F.col("told").alias("lang"), "lines", *names, "distance", "limit", *parts, "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p8_packing": p8_packing, "p8_fill": p8_fill, "p9_found": p9_found, "p9_spans": p9_spans, "p10_found": p10_found, "p10_statistics": p10_statistics}

def _words_sql(text: str) -> str:
    """The words of a text, for the entities, signs and accents that the test tables hold."""
    wide = "".join(chr(c + 0xFEE0) for c in range(33, 127))
    plain = "".join(chr(c) for c in range(33, 127)).replace("'", "''")
    t = f"regexp_replace({text}, '<!--.*?-->|</?[A-Za-z!?][^<>]*>', ' ', 'gs')"
    t = f"replace(replace({t}, '&nbsp;', ' '), '&#32;', ' ')"
    for sign, parts in (("¼", "1⁄4"), ("½", "1⁄2"), ("¾", "3⁄4")):
        t = f"replace({t}, '{sign}', '{parts}')"
    t = f"translate({t}, '{wide}', '{plain}')"
    t = f"regexp_replace({t}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FE0F}}\\x{{FEFF}}\\x{{0300}}-\\x{{036F}}]', '', 'g')"
    return f"regexp_extract_all(lower(strip_accents({t})), '[\\p{{L}}\\p{{N}}]+')"


_P9 = f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT eval_id, {_words_sql("text")} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT eval_id, j, array_to_string(w[j:j + 11], ' ') AS g FROM (SELECT eval_id, w, unnest(range(1, len(w) - 10)) AS j FROM e)),
h AS (SELECT doc_id, eval_id, i, i - j AS diagonal, i - row_number() OVER (PARTITION BY doc_id, eval_id, i - j ORDER BY i) AS island FROM dg JOIN eg USING (g)),
r AS (SELECT doc_id, eval_id, min(i) - 1 AS start, count(*) + 11 AS length FROM h GROUP BY doc_id, eval_id, diagonal, island),
p9 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, eval_id ORDER BY length DESC, start) = 1)
"""
SQL: dict[str, str] = {"p9_found": _P9 + "SELECT doc_id, eval_id FROM p9", "p9_spans": _P9 + "SELECT doc_id, eval_id, start, length FROM p9"}
