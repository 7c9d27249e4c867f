"""Rows of JSON documents as typed frames."""

from __future__ import annotations

import math
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def records_of(payload: Any) -> list[dict]:
    """A response is one record or many."""
    match payload:
        case dict():
            return [payload]
        case list():
            return payload
    raise ValueError(f"no records in a response of type {type(payload).__name__}")


def _moment(text: str) -> datetime | None:
    try:
        return datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None


def kind_of(values: list[Any]) -> str:
    """Type of the values of a field that aren't null; the first that fits all."""
    if not values:
        return "string"
    kinds = {type(v) for v in values}
    if kinds == {bool}:
        return "bool"
    if kinds == {int}:
        return "int"
    if kinds <= {int, float}:
        return "float"
    if kinds == {date}:
        return "date"
    if kinds == {datetime}:
        return "datetime"
    if kinds == {str}:
        moments = [_moment(v) for v in values]
        if all(moments):
            return "date" if all(m.hour == m.minute == m.second == m.microsecond == 0 for m in moments) else "datetime"
        return "string"
    return "object"


def infer(records: list[dict]) -> dict[str, dict[str, Any]]:
    """Field -> {"dtype", "nullable"}, fields in the order they first come. Nullable is what is there with null."""
    values: dict[str, list] = {}
    for r in records:
        for k, v in r.items():
            values.setdefault(k, []).append(None if isinstance(v, float) and math.isnan(v) else v)
    return {k: {"dtype": kind_of([v for v in vs if v is not None]), "nullable": any(v is None for v in vs)} for k, vs in values.items()}


_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "date": T.TimestampType(), "datetime": T.TimestampType(), "string": T.StringType(), "object": T.StringType()}


def to_frame(spark: SparkSession, payload: Any) -> DataFrame:
    """A response's rows with inferred types. What the driver fetched is small; large feeds are read as files."""
    records = records_of(payload)
    kinds = {k: v["dtype"] for k, v in infer(records).items()}
    if not kinds:
        return spark.createDataFrame([], T.StructType([]))

    def cell(v: Any, kind: str) -> Any:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if kind == "float":
            return float(v)
        if kind in ("bool", "int"):
            return v
        return v.isoformat() if isinstance(v, (date, datetime)) else v if isinstance(v, str) else str(v)

    raw = T.StructType([T.StructField(k, t if isinstance(t := _TYPES[kind], (T.BooleanType, T.LongType, T.DoubleType)) else T.StringType()) for k, kind in kinds.items()])
    df = spark.createDataFrame([tuple(cell(r.get(k), kind) for k, kind in kinds.items()) for r in records], raw)
    return df.select(*[F.col(f"`{k}`").try_cast("timestamp").alias(k) if kind in ("date", "datetime") else F.col(f"`{k}`") for k, kind in kinds.items()])
