"""Texts of values as the expression language prints them, and formats of dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _double_text(c: Column) -> Column:
    """Shortest digits: plain from 1e-4 up to 1e16, else with an exponent of at least two digits."""
    raw = c.cast("string")
    size = F.abs(c)
    parts = F.split(raw, "E")
    mantissa = F.regexp_replace(parts[0], r"\.0$", "")
    power = F.try_element_at(parts, F.lit(2)).cast("int")
    scientific = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    plain = F.regexp_replace(F.when(plain.contains("."), plain).otherwise(F.concat(plain, F.lit("."))), r"\.$", ".0")
    in_java_range = (size >= 1e-3) & (size < 1e7)
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size == 0) | in_java_range, raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def text_of(c: Column, kind: T.DataType) -> Column:
    """The text of a value of a type; nulls have one too (fixed values: <NA>, nan, None, NaT)."""
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNull(), "<NA>").when(c, "True").otherwise("False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(_double_text(c.cast("double")), F.lit("nan"))
    if isinstance(kind, T.DateType):
        return F.coalesce(c.cast("string"), F.lit("None"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        zone = F.lit("+00:00" if isinstance(kind, T.TimestampType) else "")
        return F.coalesce(F.concat(seconds, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), zone), F.lit("NaT"))
    if isinstance(kind, T.NullType):
        return F.lit("None")
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit("<NA>"))
    return F.coalesce(c.cast("string"), F.lit("<NA>"))


#: strptime directives and the patterns of Spark (fixed values).
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "VV", "%": "%",
}
WHOLE = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "D": "%m/%d/%y", "R": "%H:%M"}


def spark_pattern(strptime: str) -> str:
    """A strptime format as a pattern of Spark; text between directives is quoted."""
    for d, full in WHOLE.items():
        strptime = strptime.replace(f"%{d}", full)
    out, plain = [], ""
    i = 0
    while i < len(strptime):
        if strptime[i] != "%":
            plain += strptime[i]
            i += 1
            continue
        directive = strptime[i + 1 : i + 2]
        if directive not in DIRECTIVES:
            raise ValueError(f"format directive %{directive} isn't supported")
        if directive == "%":
            plain += "%"
        else:
            out.append(_quoted(plain))
            out.append(DIRECTIVES[directive])
            plain = ""
        i += 2
    return "".join([*out, _quoted(plain)])


def _quoted(plain: str) -> str:
    return re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", plain.replace("'", "''"))


#: Patterns tried in turn where no format is given.
ISO_PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
