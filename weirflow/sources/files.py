"""Files as frames: CSV, JSON, Excel and Parquet, plain or by a named format, each row with the name of its file."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.operators.record_parse import tokenize_ranges
from weirflow.session import opened

KINDS = {".csv": "csv", ".json": "json", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet"}


@dataclass
class Format:
    """A named file format. Keys that aren't named here go to the reader as they are."""

    name: str
    type: str
    config: dict[str, Any] = field(default_factory=dict)
    description: str | None = None

    def __post_init__(self) -> None:
        if self.type not in ("csv", "json", "excel", "parquet"):
            raise ValueError(f"format '{self.name}': unknown type '{self.type}'")


_CSV_KEYS = {"delimiter": "sep", "field_delimiter": "sep", "encoding": "encoding", "quote_char": "quote", "escape_char": "escape", "comment": "comment"}


def kind_of(path: str) -> str:
    for suffix, kind in KINDS.items():
        if path.lower().split("?")[0].rstrip("/").endswith(suffix) or path.lower().endswith(suffix + ".gz"):
            return kind
    raise ValueError(f"unsupported file type: {path}")


_SELECTING = {"pathglobfilter", "recursivefilelookup", "modifiedbefore", "modifiedafter", "basepath"}


@dataclass(frozen=True)
class Csv:
    """One CSV file: whether it is UTF-8 throughout, whether a quoted field may hold a line break, and where its records begin."""

    path: str
    size: int
    encoding: str
    breaks: bool
    header: str | None
    data_at: int


def csv_files(spark: SparkSession, path: str, wanted: str = "utf-8", options: dict[str, Any] | None = None, skip: int = 0, header: bool = True, quote: str = '"') -> list[Csv]:
    """Every file with lines: one pass over all lines of all files, and one ranged read of each head. One row per file reaches the driver.

    No byte of a longer sequence is a line break, so a file is UTF-8 if each of its lines is, and a file is read as latin-1 that isn't.
    A field goes on over a line break only if some line holds an odd number of quotes.
    """
    selecting = {k: str(v) for k, v in (options or {}).items() if k.lower() in _SELECTING}
    lines = spark.read.options(**selecting).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit(""))) if quote else F.lit(0)
    meta = F.col("_metadata")
    files = lines.groupBy(meta["file_path"].alias("file"), meta["file_size"].alias("size")).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("breaks"))
    utf8 = wanted.lower().replace("-", "") == "utf8"

    def heads(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                encoding = wanted if not utf8 else "UTF-8" if r.utf8 else "ISO-8859-1"
                head, at = _head(r.file, skip + bool(header))
                first = head[-1].decode(encoding, "replace").lstrip("\ufeff") if header and len(head) > skip else None
                out.append([r.file, r.size, encoding, r.breaks, first, at])
            yield pd.DataFrame(out, columns=["file", "size", "encoding", "breaks", "header", "data_at"])

    found = files.mapInPandas(heads, "file string, size long, encoding string, breaks boolean, header string, data_at long")
    return [Csv(*r) for r in found.orderBy("file").collect()]


def _head(uri: str, lines: int, step: int = 1 << 16) -> tuple[list[bytes], int]:
    """The first lines of a file, without their ends, and the byte behind them."""
    place, inner = opened(unquote(uri))
    held = b""
    with place.open_input_stream(inner) as f:  # unpacked as its suffix says
        while held.count(b"\n") < lines and (more := f.read(step)):
            held += more
    head = held.split(b"\n")[:lines]
    return [x.rstrip(b"\r") for x in head], min(len(held), sum(len(x) + 1 for x in head))


def _literal(uri: str) -> str:
    """The path of a file's URI, without meaning to the globs of a reader."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", unquote(uri))


def _nulled(df: DataFrame, tokens: list[str]) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(~F.trim(F.col(f"`{n}`")).isin(tokens), F.col(f"`{n}`")) for n in texts}) if texts else df


def _inferred(df: DataFrame) -> DataFrame:
    """Texts as the narrowest type that takes all of a column's values: one pass over all columns."""
    def fits(c: Column, t: str) -> Column:
        return F.count_if(c.isNotNull() & c.try_cast(t).isNull()).alias(t)

    wanted = ["bigint", "double", "boolean"]
    if not df.columns:
        return df
    row = df.agg(*[F.struct(F.count(F.col(f"`{n}`")).alias("held"), *[fits(F.col(f"`{n}`"), t) for t in wanted]).alias(str(i)) for i, n in enumerate(df.columns)]).first()
    out = []
    for i, n in enumerate(df.columns):
        kind = next((t for t in wanted if row[str(i)]["held"] and not row[str(i)][t]), "string")
        out.append(F.col(f"`{n}`").try_cast(kind).alias(n) if kind != "string" else F.col(f"`{n}`"))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, config: dict[str, Any] | None = None, span: int = 32 << 20) -> DataFrame:
    """Options by the names of formats: delimiter, skip_header (lines before the header), encoding, null_if, quote_char, escape_char, header.

    Files are split among tasks by lines; those in which a quoted field may hold a line break, or lines are skipped, by the records
    that the tokenizer finds in ranges of ``span`` bytes. Every file is read by its own header and encoding. Packed files, and
    separators or quotes that the tokenizer doesn't know, are split by file only where fields hold line breaks.
    """
    c = dict(config or {})
    options = {_CSV_KEYS[k]: c.pop(k) for k in list(c) if k in _CSV_KEYS}
    wanted = str(options.pop("encoding", "utf-8"))
    nulls = c.pop("null_if", None)
    skip = int(c.pop("skip_header", 0) or 0)
    header = c.pop("header", True) not in (False, None, "None")
    c.pop("compression", None)  # told from the suffix
    infer = c.pop("infer", True)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", **options, **{k: str(v) for k, v in c.items()}}
    sep = options.get("sep", ",")
    groups: dict[tuple, list[Csv]] = {}
    for f in csv_files(spark, path, wanted, options, skip, header, options["quote"]):
        groups.setdefault((f.encoding, f.breaks or skip > 0, f.header), []).append(f)
    parts = []
    for (encoding, by_records, head), files in groups.items():
        quote = options["quote"]
        known = len(sep) == len(quote) == 1 and (sep + quote).isascii() and options["escape"] in (quote, '"') and not any(f.path.endswith((".gz", ".bz2", ".zst")) for f in files)
        if skip and not known:
            raise ValueError(f"lines can't be skipped in {files[0].path}: it is packed, or its separator or quote isn't one ASCII character")
        if by_records and known:
            parts.append(_by_records(spark, files, head, options, span))
        else:
            selecting = {k: v for k, v in options.items() if k.lower() != "pathglobfilter"}
            one = len(files) == 1 and unquote(files[0].path).endswith(path.removeprefix("file://").rstrip("/"))
            base = {} if one or re.search(r"[{}\[\]*?\\]", path) or "basepath" in map(str.lower, options) else {"basePath": path}
            parts.append(_plain(spark, [_literal(f.path) for f in files], header, {**selecting, **base, "encoding": encoding, "multiLine": str(by_records).lower()}))
    if not parts:
        return spark.createDataFrame([], "file_name string")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    df = df.select(*[f"`{n}`" for n in df.columns if n != "file_name"], "file_name")
    tokens = ["", *([nulls] if isinstance(nulls, str) else [str(x) for x in nulls or ["NULL", "null", "NaN", "nan", "N/A", "NA", "n/a", "None"]])]
    body = _nulled(df, tokens)
    return _typed_keeping(body) if infer else body


def _plain(spark: SparkSession, paths: list[str], header: bool, options: dict[str, str]) -> DataFrame:
    df = spark.read.options(**options, header=str(header).lower()).csv(paths)
    if not header:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def _typed_keeping(df: DataFrame) -> DataFrame:
    plain = [c for c in df.columns if c != "file_name"]
    kinds = {f.name: f.dataType for f in _inferred(df.select(*[f"`{c}`" for c in plain])).schema.fields}
    return df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) for c in plain], "file_name")


def _by_records(spark: SparkSession, files: list[Csv], head: str | None, options: dict[str, str], span: int) -> DataFrame:
    """Records by the tokenizer, of files with one header, each from where its records begin. A quote that is never closed is an error, not a silent row."""
    sep = options.get("sep", ",")
    raw = tokenize_ranges(spark, [(unquote(f.path), f.size, f.data_at) for f in files], sep, span, encoding=files[0].encoding, quote=options["quote"])
    if head is None:
        width = max(len(next(csv.reader([h[0].decode(files[0].encoding, "replace")], delimiter=sep), [])) if (h := _head(f.path, 1)[0]) else 0 for f in files[:1])
        names = [str(i) for i in range(width)]
    else:
        names = [n.strip() for n in next(csv.reader([head], delimiter=sep, quotechar=options["quote"]), [])]
    schema = ", ".join(f"`{n}` string" for n in names)
    whole = F.when(F.col("more") | (F.col("part") > 0), F.raise_error(F.concat(F.lit("a quote isn't closed behind byte "), F.col("start").cast("string"), F.lit(" of "), F.col("path")))).otherwise(F.regexp_replace("raw", "\r+$", ""))
    rows = raw.select(whole.alias("value"), F.regexp_extract("path", "[^/]+$", 0).alias("file_name")).filter("value <> ''")
    parsed = rows.select(F.from_csv("value", schema, {"sep": sep, "quote": options["quote"], "escape": options["escape"]}).alias("r"), "file_name")
    return parsed.select("r.*", "file_name")


def read_json(spark: SparkSession, path: str, config: dict[str, Any] | None = None) -> DataFrame:
    """An array of records, or lines (``lines: true``); orient columns, index, split and values on the driver."""
    c = dict(config or {})
    lines, orient = bool(c.pop("lines", False)), c.pop("orient", None)
    if orient in (None, "records"):
        options = {"multiLine": str(not lines).lower(), **({"encoding": c["encoding"]} if "encoding" in c else {})}
        return spark.read.options(**options).json(path).withColumn("file_name", F.col("_metadata.file_name"))
    import json

    parts = []
    for r in spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f")).toLocalIterator():
        parts.append(_oriented(spark, json.loads(r["value"]), orient).withColumn("file_name", F.lit(r["f"])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _oriented(spark: SparkSession, data: Any, orient: str) -> DataFrame:
    from weirflow.sources.inference import to_frame

    if orient == "split":
        rows = [dict(zip(data["columns"], r)) for r in data["data"]]
    elif orient == "index":
        rows = list(data.values())
    elif orient == "columns":
        rows = [{c: data[c].get(k) for c in data} for k in (next(iter(data.values())) if data else {})]
    elif orient == "values":
        rows = [{str(i): v for i, v in enumerate(r)} for r in data]
    else:
        raise ValueError(f"unknown JSON orient '{orient}'")
    return to_frame(spark, rows)


def read_excel(spark: SparkSession, path: str, config: dict[str, Any] | None = None) -> DataFrame:
    """The sheet's rows under the names of its first row (sheet_name: name or number from 0; skip_header: rows before the names; header: None for numbers).

    A workbook is one packed file of bounded size, so one process reads it; several of a folder are read apart.
    """
    from weirflow.sources.inference import to_frame
    from weirflow.sources.workbook import sheet_rows

    c = dict(config or {})
    skip = int(c.pop("skip_header", c.pop("skiprows", 0)) or 0)
    header = c.pop("header", True)
    header = not (header is None or header is False or header == "None")
    place, inner = opened(path)
    with place.open_input_file(inner) as f:
        rows = sheet_rows(f, c.pop("sheet_name", 0))[skip:]
    width = max(map(len, rows), default=0)
    rows = [[*r, *[None] * (width - len(r))] for r in rows]
    names = [str(n) if n is not None else f"Unnamed: {i}" for i, n in enumerate(rows.pop(0))] if header and rows else [str(i) for i in range(width)]
    return to_frame(spark, [dict(zip(names, r)) for r in rows if any(x is not None for x in r)]).withColumn("file_name", F.lit(path.rsplit("/", 1)[-1]))


def read_parquet(spark: SparkSession, path: str, config: dict[str, Any] | None = None) -> DataFrame:
    return spark.read.options(**{k: str(v) for k, v in (config or {}).items()}).parquet(path).withColumn("file_name", F.col("_metadata.file_name"))


_READERS = {"csv": read_csv, "json": read_json, "excel": read_excel, "parquet": read_parquet}


def read_file(spark: SparkSession, path: str, fmt: Format | None = None) -> DataFrame:
    return _READERS[fmt.type if fmt else kind_of(path)](spark, path, fmt.config if fmt else None)
