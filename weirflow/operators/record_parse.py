"""Delimited records: a quote-aware finite-state tokenizer, typed rows apart from failed ones.

The tokenizer is one table of transitions over five states. A buffer of bytes is cut into chunks of
equal length; for every chunk the map "state at its start -> state at its end" is computed for all
start states at once, the maps are composed by a doubling scan, and a second pass over the chunks
runs with the right start state. All chunks advance in step, so the work is vectorised and
no byte depends on a sequential scan of the bytes before it. The same maps serve raw files that are read in
ranges on several executors (``tokenize_ranges``): there each range sends only its map.

Defined results of ``parse_records`` in the odd cases:
* null or blank lines, lines starting with ``#`` and header lines are no records and give no row;
* a file without a header gives no records; a null file name is a file of its own;
* an empty table gives an empty table with the same columns;
* very long lines are handled whole; repeated rows give repeated results;
* columns of the input besides the four named ones are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import opened

# states
START, PLAIN, QUOTED, AFTER_QUOTE, BROKEN = range(5)
# input classes
OTHER, QUOTE, SEP, END = range(4)

#: STEP[class, state] -> next state.
STEP = np.array(
    [
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
        [QUOTED, BROKEN, AFTER_QUOTE, QUOTED, BROKEN],
        [START, START, QUOTED, START, BROKEN],
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
#: The same where the end class is a line break of a raw file: inside quotes it is text.
STEP_FILE = STEP.copy()
STEP_FILE[END, QUOTED] = QUOTED

N_STATES = STEP.shape[1]
CHUNK = 512


def chunk_maps(classes: np.ndarray, step: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """For every chunk the map of start states to end states (chunks x states)."""
    n = -(-len(classes) // chunk)
    padded = np.full(n * chunk, 255, dtype=np.uint8)
    padded[: len(classes)] = classes
    lanes = np.ascontiguousarray(padded.reshape(n, chunk).T)
    table = np.vstack([step, np.tile(np.arange(N_STATES, dtype=np.uint8), (256 - len(step), 1))])
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (n, 1))
    for column in lanes:
        maps = table[column[:, None], maps]
    return maps


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of maps under composition, by doubling: row i maps the first start to the end of chunk i."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return out


def states_before(classes: np.ndarray, step: np.ndarray, start: int = START, chunk: int = CHUNK) -> np.ndarray:
    """The state before every byte, given the state before the first."""
    if not len(classes):
        return np.zeros(0, dtype=np.uint8)
    n = -(-len(classes) // chunk)
    ends = compose(chunk_maps(classes, step, chunk))[:, start]
    at = np.concatenate([[start], ends[:-1]]).astype(np.uint8)
    padded = np.zeros(n * chunk, dtype=np.uint8)
    padded[: len(classes)] = classes
    lanes = np.ascontiguousarray(padded.reshape(n, chunk).T)
    out = np.empty((chunk, n), dtype=np.uint8)
    for i, column in enumerate(lanes):
        out[i] = at
        at = step[column, at]
    return out.T.reshape(-1)[: len(classes)]


def _buffer(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All lines behind each other, each followed by one end byte; and the end positions."""
    lines = lines.cast(pa.large_binary())
    offsets = np.frombuffer(lines.buffers()[1], dtype=np.int64, count=len(lines) + 1, offset=lines.offset * 8)
    data = np.frombuffer(lines.buffers()[2], dtype=np.uint8) if lines.buffers()[2] else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    cuts = offsets[1:] - offsets[0]
    return np.insert(data, cuts, 10), cuts + np.arange(len(lines))


def tokenize(lines: pa.Array, seps: pa.Array, chunk: int = CHUNK) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Fields of each record (list of strings), the offsets in bytes at which they start (and at which one more would), and the offset of its quoting error, -1 where it has none."""
    if not len(lines):
        return pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.int64())), np.zeros(0, dtype=np.int64)
    data, ends = _buffer(lines)
    lengths = np.diff(np.concatenate([[-1], ends]))
    sep = np.frombuffer(b"".join(s.encode()[:1] or b"," for s in seps.to_pylist()), dtype=np.uint8)
    classes = np.zeros(len(data), dtype=np.uint8)
    classes[data == 34] = QUOTE
    classes[data == np.repeat(sep, lengths)] = SEP
    classes[ends] = END
    before = states_before(classes, STEP, START, chunk)
    after = STEP[classes, before]

    begins = np.concatenate([[0], ends[:-1] + 1])
    wrong = np.flatnonzero(((after == BROKEN) & (before != BROKEN)) | ((classes == END) & (before == QUOTED)))
    record = np.searchsorted(ends, wrong)
    error = np.full(len(ends), -1, dtype=np.int64)
    error[record[::-1]] = (wrong - begins[record])[::-1]

    border = (classes == END) | ((classes == SEP) & (before != QUOTED) & (before != BROKEN))
    markup = (classes == QUOTE) & ((before == START) | (before == QUOTED))
    keep = ~border & ~markup
    kept = np.concatenate([[0], np.cumsum(keep)])
    at = np.flatnonzero(border)
    offsets = np.concatenate([[0], kept[at]]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))
    count = np.searchsorted(at, ends) + 1
    lists = np.concatenate([[0], count]).astype(np.int32)
    # a field starts behind the border before it; the end of a record is one less than the start of the field it has no more
    behind = np.insert(at + 1, np.concatenate([[0], count[:-1]]), begins)
    own = np.repeat(begins, np.diff(lists) + 1)
    starts = pa.ListArray.from_arrays(pa.array(lists + np.arange(len(lists), dtype=np.int32), pa.int32()), pa.array(behind - own))
    return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), text.cast(pa.string())), starts, error


def _tokenize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fields, starts, error = tokenize(b.column("line"), b.column("sep"))
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], fields, starts, pa.array(error)], names=[*b.schema.names[:-2], "fields", "starts", "error_at"])


def _blank_free(c: Column) -> Column:
    return F.trim(c, F.lit(" \t"))


def headers(rows: DataFrame) -> DataFrame:
    """Separator and lower-cased column names of each file, once for every block of its lines."""
    first = rows.groupBy("file").agg(F.min_by(F.struct("id", "line"), F.struct("no", "id")).alias("first"), F.max("block").alias("blocks"))
    line = F.regexp_replace("first.line", "^\ufeff", "")
    sep = F.regexp_extract(line, "[,|;\t]", 0)
    return first.select(
        "file",
        F.explode(F.sequence(F.lit(0), "blocks")).alias("block"),
        F.col("first.id").alias("header"),
        F.when(sep == "", ",").otherwise(sep).alias("sep"),
        F.transform(F.split(line, "[,|;\t]"), lambda x: F.lower(F.regexp_replace(x, r'^[\s"]+|[\s"]+$', ""))).alias("names"),
    )


def parse_records(
    lines: DataFrame,
    columns: list[str],
    amount: str = "amount",
    day: str = "txn_date",
    key: str = "line_id",
    file: str = "file_name",
    number: str = "line_no",
    raw: str = "raw_line",
    block: int = 10_000,
    salts: int = 4_096,
) -> DataFrame:
    """Every record as a row: key, reason (null if good), error_at, and the typed columns.

    ``reason`` is the first that holds of quoting, columns, ``amount`` and ``day``; ``error_at`` the offset in bytes
    of the record at which it shows: the sign that breaks the quoting, the first field too many (the end, if one is missing), or the
    field that is wrong. Of a failed record the columns are null. The header of a file is joined by file and
    block of lines, so a file that holds a third of all rows is spread over many tasks.
    """
    content = F.rtrim(F.col(raw), F.lit("\r"))
    rows = lines.select(
        F.col(key).alias("id"),
        F.coalesce(F.concat(F.lit("f"), F.col(file)), F.lit("n")).alias("file"),
        F.coalesce(F.col(number), F.lit(0)).cast("long").alias("no"),
        content.alias("line"),
    )
    bare = F.when(F.col("line").startswith("\ufeff"), F.substring("line", 2, 1 << 30)).otherwise(F.col("line"))
    rows = rows.filter(F.col("line").isNotNull() & bare.rlike(r"\S") & ~bare.startswith("#"))
    rows = rows.withColumn("block", F.pmod(F.expr(f"no div {block}"), F.lit(salts)).cast("int"))
    records = rows.join(headers(rows), ["file", "block"]).filter(~F.col("id").eqNullSafe(F.col("header")))
    tokens = records.select("id", "names", "line", "sep").mapInArrow(_tokenize_batches, _token_schema(rows))

    def field(name: str) -> Column:
        return F.try_element_at("fields", F.nullif(F.array_position("names", F.lit(name)).cast("int"), F.lit(0)))

    number_text = _blank_free(field(amount))
    day_text = _blank_free(field(day))
    out = tokens.withColumns({"_number": number_text, "_day": day_text}).withColumns(
        {
            "_no_day": F.col("_day").isNull() | F.col("_day").isin("", "NULL", "N/A"),
            "_real_day": F.col("_day").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~F.col("_day").startswith("0000") & F.expr("try_cast(_day as date)").isNotNull(),
            "_is_number": F.coalesce(F.col("_number").rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\z"), F.lit(False)),
        }
    )
    out = out.withColumn(
        "reason",
        F.when(F.col("error_at") >= 0, "quoting")
        .when(F.size("fields") != len(columns), "columns")
        .when(~F.col("_is_number"), amount)
        .when(~(F.col("_no_day") | F.coalesce(F.col("_real_day"), F.lit(False))), day),
    )
    good = F.col("reason").isNull()

    def start(name: str) -> Column:
        """Where a field starts; the end of the record if there is none."""
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.coalesce(F.try_element_at("starts", F.nullif(at, F.lit(0))), F.element_at("starts", -1) - 1)

    where = F.when(F.col("reason") == "quoting", F.col("error_at")).when(F.col("reason") == "columns", F.coalesce(F.get("starts", F.lit(len(columns))), F.element_at("starts", -1) - 1))
    where = where.when(F.col("reason") == amount, start(amount)).when(F.col("reason") == day, start(day))

    def typed(name: str) -> Column:
        if name == amount:
            return F.when(good, F.expr("try_cast(_number as double)"))
        if name == day:
            return F.when(good & F.col("_real_day"), F.expr("try_cast(_day as date)"))
        text = _blank_free(field(name))
        return F.when(good & ~text.isin("", "NULL", "N/A", "null"), text)

    return out.select(F.col("id").alias(key), "reason", where.alias("error_at"), *[typed(c).alias(c) for c in columns])


def _token_schema(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}, names array<string>, fields array<string>, starts array<bigint>, error_at bigint"


# --- raw files, read in ranges ------------------------------------------------------------------------------------


def _read_range(path: str, offset: int, length: int) -> bytes:
    place, inner = opened(path)
    with place.open_input_file(inner) as f:
        return f.read_at(length, offset)


def _classes(data: np.ndarray, sep: str, quote: str = '"') -> np.ndarray:
    c = np.zeros(len(data), dtype=np.uint8)
    c[data == ord(quote)] = QUOTE
    c[data == ord(sep)] = SEP
    c[data == 10] = END
    return c


def _borders(data: bytes, sep: str, quote: str, state: int) -> list[int]:
    """Positions of the line breaks that end a record."""
    c = _classes(np.frombuffer(data, dtype=np.uint8), sep, quote)
    return np.flatnonzero((c == END) & (states_before(c, STEP_FILE, state) != QUOTED)).tolist()


def _state_after(data: bytes, sep: str, quote: str, state: int) -> int:
    c = _classes(np.frombuffer(data, dtype=np.uint8), sep, quote)
    return int(compose(chunk_maps(c, STEP_FILE))[-1][state]) if len(c) else state


def tokenize_ranges(spark: SparkSession, files: list[tuple], sep: str = ",", span: int = 32 << 20, most: int = 64 << 20, encoding: str = "utf-8", quote: str = '"') -> DataFrame:
    """Records of raw files of any size, read in ranges of ``span`` bytes: path, start, part, more, raw (the record's text).

    files: path, size, and the byte at which records begin (0 if left out).

    1. Every range sends the map of its start states to its end states (five small numbers).
    2. The maps are composed per file, in the order of the ranges, which gives each range its start state.
    3. Every range finds its record borders knowing that state, so a line break inside quotes is text even
       if the quote was opened in an earlier range. A record belongs to the range in which it starts; its
       rest is read from the ranges behind.
    A broken quote holds until the next line break; a quote never closed makes one record of the rest of the file. A record of over
    ``most`` bytes comes in parts, numbered from 0, of about that size, ``more`` being true but for the last, so no task holds
    more than one part and nothing is lost.
    """
    plan = [(f[0], f[1], o, min(span, f[1] - o)) for f in files for o in range(f[2] if len(f) > 2 else 0, f[1], span)]
    begin = {f[0]: f[2] if len(f) > 2 else 0 for f in files}
    schema = "path string, size long, start long, length long"
    if not plan:
        return spark.createDataFrame([], "path string, start long, part int, more boolean, raw string")
    parts = spark.createDataFrame([(*x, begin[x[0]]) for x in plan], schema + ", begin long").repartition(min(len(plan), 4096), "path", "start")

    def maps(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for path, size, start, length, first in b.itertuples(index=False):
                data = np.frombuffer(_read_range(path, start, length), dtype=np.uint8)
                m = compose(chunk_maps(_classes(data, sep, quote), STEP_FILE))[-1]
                yield _frame([[path, size, start, length, first, m.tolist()]], ["path", "size", "start", "length", "begin", "map"])

    sent = parts.mapInPandas(maps, schema + ", begin long, map array<int>")

    def starts(pdf):  # noqa: ANN001, ANN202
        state, out = START, []
        for path, size, start, length, first, m in pdf.sort_values("start").itertuples(index=False):
            out.append([path, size, start, length, first, state])
            state = int(m[state])
        return _frame(out, ["path", "size", "start", "length", "begin", "state"])

    known = sent.groupBy("path").applyInPandas(starts, schema + ", begin long, state int")

    def cut_records(batches):  # noqa: ANN001, ANN202
        names = ["path", "start", "part", "more", "raw"]
        # bytes of one character may be cut apart between parts
        text = lambda x: x.decode(encoding, "replace")
        for b in batches:
            for path, size, start, length, first, state in b.itertuples(index=False):
                body = _read_range(path, start, length)
                borders = _borders(body, sep, quote, state)
                # a range owns the records behind its own borders, and the file's first
                begins = ([0] if start == first else []) + [x + 1 for x in borders if start + x + 1 < size]
                if not begins:
                    continue
                ends = borders if start == first else borders[1:]
                yield _frame([[path, start + x, 0, False, text(body[x:e])] for x, e in zip(begins, ends)], names)
                if len(begins) == len(ends):
                    continue
                # the last record goes on behind the range
                held, at, s, part = body[begins[-1] :], start + length, _state_after(body, sep, quote, state), 0
                while at < size:
                    piece = _read_range(path, at, min(span, size - at))
                    more = _borders(piece, sep, quote, s)
                    held += piece[: more[0]] if more else piece
                    if more:
                        break
                    s, at = _state_after(piece, sep, quote, s), at + len(piece)
                    if len(held) > most and at < size:
                        whole = most - next((i for i in range(4) if encoding.lower().replace("-", "") != "utf8" or held[most - i] & 0xC0 != 0x80), 0)
                        yield _frame([[path, start + begins[-1], part, True, text(held[:whole])]], names)
                        held, part = held[whole:], part + 1
                yield _frame([[path, start + begins[-1], part, False, text(held)]], names)

    return known.mapInPandas(cut_records, "path string, start long, part int, more boolean, raw string")


def _frame(rows: list, names: list[str]):  # noqa: ANN202
    import pandas as pd

    return pd.DataFrame(rows, columns=names)
