"""Regular expressions for a column, chosen by minimum description length over the distinct values of all its loads.

Values are summed up by their skeleton (runs of one character class), which Spark does over all values. An
expression is either a skeleton (``[a-z]+_[a-z]+``) or the closure of a set of classes (``[a-z_]+``). The description
length is the bits of the chosen expressions plus the bits of each value under the cheapest of them that it matches, or
under "anything". A value counts once for each load that holds it, so what every load holds weighs more than a load gone astray.

A skeleton whose values can't save the bits that naming it costs is given to the driver only as a part of its character set.
Beyond ``MOST`` skeletons the shorter ones go the same way, and beyond ``MOST`` character sets the rest is one fact that only
the closure of all characters covers; every value stays in the description, and what is collected has that bound.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbol of a class in skeletons, its expression and size. Other ASCII signs stand for themselves; ``o`` is all the rest.
CLASSES = {"9": ("0-9", 10), "a": ("a-z", 26), "A": ("A-Z", 26), "s": (" ", 1), "o": (None, 1 << 16)}
ANY_BITS = 8.0
SYMBOL_BITS = math.log2(40)
#: Skeletons, and after them character sets, that are told apart (of all columns together).
MOST = 600


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def shape(value: Column) -> Column:
    """One symbol per character."""
    known = F.translate(value, _LOWER + _UPPER + _DIGITS + " ", "a" * 26 + "A" * 26 + "9" * 10 + "\u0002")
    return F.when(known.rlike(r"[^\x02-\x7e]"), F.regexp_replace(known, r"[^\x02-\x7e]", "o")).otherwise(known)


def skeletons(values: DataFrame) -> DataFrame:
    """column, skeleton, n (values), chars, code (bits of the lengths of runs), whole_code (bits of the lengths).

    values: column, value; one row per distinct value of a load. Skeletons of over 8 runs are summed up as their set of symbols ("~" first).
    """
    s = values.filter("value IS NOT NULL").select("column", shape(F.col("value")).alias("shape")).groupBy("column", "shape").agg(F.count("*").alias("n"))
    runs = F.regexp_extract_all("shape", F.lit(r"((.)\2*)"), F.lit(1))
    flat = F.regexp_replace("shape", r"(.)\1+", "$1")
    long = F.length(flat) > 8
    name = F.when(long, F.concat(F.lit("~"), F.array_join(F.array_sort(F.array_distinct(F.split("shape", ""))), ""))).otherwise(flat)
    bits = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + 2 * F.log2(F.length(r) + F.lit(1.0)) + 1)
    n = F.col("n")
    per = s.select("column", name.alias("skeleton"), n, (n * F.length("shape")).alias("chars"), (n * bits).alias("code"), (n * (2 * F.log2(F.length("shape") + F.lit(1.0)) + 1)).alias("whole_code"), F.transform(runs, lambda r: F.length(r)).alias("lengths"))
    return per.groupBy("column", "skeleton").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("code").alias("code"), F.sum("whole_code").alias("whole_code"), *[F.sum(n * F.coalesce(F.get("lengths", F.lit(i)), F.lit(0))).alias(f"run{i}") for i in range(8)])


def _regrouped(shapes: DataFrame, skeleton: Column) -> DataFrame:
    named = shapes.withColumn("skeleton", skeleton)
    return named.groupBy("column", "skeleton").agg(*[F.sum(c).alias(c) for c in shapes.columns if c not in ("column", "skeleton")])


def _symbols() -> Column:
    return F.concat(F.lit("~"), F.array_join(F.array_sort(F.array_distinct(F.split(F.ltrim(F.col("skeleton"), F.lit("~")), ""))), ""))


def folded(shapes: DataFrame) -> DataFrame:
    """Skeletons with those that can't pay for themselves summed up under their set of symbols. No value is left out."""
    pays = F.col("chars") * ANY_BITS > F.length("skeleton") * 2 * 5.3
    return _regrouped(shapes, F.when(F.col("skeleton").startswith("~") | pays, F.col("skeleton")).otherwise(_symbols()))


def facts(shapes: DataFrame, most: int = MOST) -> list[dict]:
    """At most ``most`` skeletons, as many character sets, and one rest a column (symbol \\u0001), over all values."""
    out: list[dict] = []
    rest = folded(shapes)
    for fold in (_symbols(), F.lit("~\u0001"), None):
        if fold is None:
            return out + [r.asDict() for r in rest.collect()]  # one row a column
        head = rest.orderBy(F.desc("chars"), "column", "skeleton").limit(most + 1).collect()
        out += [r.asDict() for r in head[:most]]
        if len(head) <= most:
            return out
        e = head[most - 1]
        after = F.struct(F.lit(e["column"]).alias("column"), F.lit(e["skeleton"]).alias("skeleton"))
        behind = (F.col("chars") < e["chars"]) | ((F.col("chars") == e["chars"]) & (F.struct("column", "skeleton") > after))
        rest = _regrouped(rest.filter(behind), fold)
    return out


@dataclass(frozen=True)
class Expression:
    pattern: str
    values: int
    bits: float


def _atom(symbols: str) -> tuple[str, int]:
    text, size = "", 0
    for x in symbols:
        if x == "o":
            return "[^\\x00-\\x1f]", CLASSES["o"][1]
        t, n = CLASSES.get("s" if x == "\u0002" else x, (re.escape(x) if x not in "-]^\\" else "\\" + x, 1))
        text, size = text + t, size + n
    return f"[{text}]", size


def induce(rows: list[dict]) -> list[Expression]:
    """Expressions of one column, chosen greedily as long as each shortens the description, the narrowest first. rows: of ``facts``.

    Narrow means few bits a character: of several expressions that a value matches, the first describes it best.
    """
    facts_ = [(r, "".join(sorted(set(r["skeleton"].lstrip("~"))))) for r in rows]
    candidates: dict[str, tuple[float, dict[int, float]]] = {}
    width: dict[str, tuple[int, int, str]] = {}
    for i, (r, used) in enumerate(facts_):
        k = r["skeleton"]
        if not k.startswith("~") and k:
            bits = sum(r[f"run{j}"] * math.log2(_atom(x)[1]) for j, x in enumerate(k)) + r["code"]
            key = "".join(_atom(x)[0] + "+" for x in k)
            candidates[key], width[key] = (SYMBOL_BITS * 2 * len(k), {i: bits}), (max(_atom(x)[1] for x in k), -len(k), key)
    for used in {u for _, u in facts_ if u and u != "\u0001"}:
        atom, size = _atom(used)
        fits = {i: r["chars"] * math.log2(size) + r["whole_code"] if size > 1 else r["whole_code"] for i, (r, u) in enumerate(facts_) if u and set(u) <= set(used)}
        cost = SYMBOL_BITS * (len(used) + 1)
        key = f"{atom}+"
        if key not in candidates or len(fits) > len(candidates[key][1]):
            candidates[key], width[key] = (cost, fits), (size, -1, key)
    now = {i: r["chars"] * ANY_BITS + r["whole_code"] for i, (r, _) in enumerate(facts_)}
    chosen: list[str] = []
    owner: dict[int, str] = {}
    while candidates:
        def gain(c: str) -> float:
            cost, fits = candidates[c]
            return sum(max(0.0, now[i] - b) for i, b in fits.items()) - cost

        best = max(sorted(candidates), key=gain)
        if gain(best) <= 0:
            break
        for i, b in candidates.pop(best)[1].items():
            if b < now[i]:
                now[i], owner[i] = b, best
        chosen.append(best)
    per: dict[str, list[float]] = defaultdict(lambda: [0, 0.0])
    for i, e in owner.items():
        per[e][0] += facts_[i][0]["n"]
        per[e][1] += now[i]
    return [Expression(e, int(per[e][0]), per[e][1]) for e in sorted(chosen, key=width.__getitem__) if e in per]
