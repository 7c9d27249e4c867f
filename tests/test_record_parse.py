import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from weirflow.operators.record_parse import END, QUOTE, SEP, START, STEP, STEP_FILE, chunk_maps, compose, parse_records, states_before, tokenize, tokenize_ranges

COLUMNS = ["txn_id", "account", "amount", "txn_date", "category"]
HEADER = "txn_id,account,amount,txn_date,category"


def plain_states(classes, step, start=START):
    out, s = [], start
    for c in classes:
        out.append(s)
        s = step[c, s]
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
def test_chunks_give_the_states_of_a_plain_scan(chunk):
    r = np.random.default_rng(chunk)
    for step in (STEP, STEP_FILE):
        for n in (1, 2, 63, 64, 500):
            classes = r.choice(4, n, p=[0.5, 0.2, 0.2, 0.1]).astype(np.uint8)
            assert states_before(classes, step, START, chunk).tolist() == plain_states(classes, step)
    assert states_before(np.zeros(0, np.uint8), STEP).tolist() == []


def test_composition_is_the_map_of_the_whole():
    classes = np.array([0, QUOTE, SEP, QUOTE, QUOTE, 0, END] * 9, dtype=np.uint8)
    assert compose(chunk_maps(classes, STEP, 5))[-1].tolist() == chunk_maps(classes, STEP, len(classes))[0].tolist()


def plain_fields(line, sep):
    """One record by a plain scan; None if its quoting is broken."""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, text = i + 1, ""
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                text += line[i:j]
                if line[j + 1 : j + 2] != '"':
                    i = j + 1
                    break
                text, i = text + '"', j + 2
            if i < len(line) and line[i] != sep:
                return None
        else:
            j = line.find(sep, i)
            text = line[i:] if j < 0 else line[i:j]
            if '"' in text:
                return None
            i = len(line) if j < 0 else j
        fields.append(text)
        if i >= len(line):
            return fields
        i += 1


def test_tokens_against_a_plain_scan():
    r = random.Random(5)
    lines = ["".join(r.choice('ab",,;\n é"') for _ in range(r.randint(0, 14))) for _ in range(4000)]
    fields, starts, error = tokenize(pa.array(lines), pa.array([","] * len(lines)), chunk=16)
    for line, f, at in zip(lines, fields.to_pylist(), starts.to_pylist()):
        data = line.encode()
        assert len(at) == len(f) + 1 and at[0] == 0 and at[-1] == len(data) + 1 or '"' in line
        if '"' not in line:
            assert [data[a : b - 1].decode() for a, b in zip(at, at[1:])] == f
    for line, f, e in zip(lines, fields.to_pylist(), error):
        want = plain_fields(line, ",")
        assert (e >= 0) == (want is None), line
        if want is not None:
            assert f == want, line


def test_tokens_of_nothing():
    assert tokenize(pa.array([], pa.string()), pa.array([], pa.string()))[0].to_pylist() == []


def parse(spark, lines, schema="line_id long, file_name string, line_no int, raw_line string, reason string"):
    return {r["line_id"]: r for r in parse_records(spark.createDataFrame(lines, schema), COLUMNS).collect()}


def test_reasons_and_types(spark):
    body = {
        2: ("T1,A,1.5,2026-02-01,x", None),
        3: ('"T,2",A,+7,NULL,"a ""b"" c"\r\r', None),
        4: ('T3,"A,1.5,2026-02-01,x', "quoting"),
        5: ("T4,A,1.5,2026-02-01", "columns"),
        6: ("T5,A,1.,2026-02-01,x", "amount"),
        7: ("T6,A,,2026-02-30,x", "amount"),
        8: ("T7,A,1,2026-02-30,x", "txn_date"),
        9: ("T8,A, 1 , 2026-02-03 ,", None),
        10: ('T9,A,1,N/A,"line\nbreak"', None),
        11: ("T10,A,١,2026-02-01,x", "amount"),
        12: ("T11,A,1,0000-00-00,x", "txn_date"),
        13: ('T12,A,x"y,2026-02-01,x', "quoting"),
        14: ('T13,"A"b,1,2026-02-01,x', "quoting"),
        15: ("T14,A,1,2026-2-1,x" + "y" * 50_000, "txn_date"),
    }
    lines = [(1, "f", 1, "﻿" + HEADER + "\r", "r")] + [(k, "f", k, v[0], "r") for k, v in body.items()]
    lines += [(100, "f", 100, "  ", "r"), (101, "f", 101, "# note", "r"), (102, "f", 102, None, "r"), (103, "f", 103, "\r", "r")]
    got = parse(spark, lines)
    assert {k: r["reason"] for k, r in got.items()} == {k: v[1] for k, v in body.items()}
    assert (got[2]["amount"], got[2]["txn_date"], got[2]["category"]) == (1.5, dt.date(2026, 2, 1), "x")
    assert (got[3]["txn_id"], got[3]["amount"], got[3]["txn_date"], got[3]["category"]) == ("T,2", 7.0, None, 'a "b" c')
    assert got[9]["category"] is None and got[10]["category"] == "line\nbreak"
    assert got[4]["txn_id"] is None and got[4]["error_at"] == len('T3,"A,1.5,2026-02-01,x')
    assert got[14]["error_at"] == 7 and got[13]["error_at"] == 7
    assert got[5]["error_at"] == len("T4,A,1.5,2026-02-01") and got[6]["error_at"] == got[7]["error_at"] == 5 and got[8]["error_at"] == 7
    assert got[2]["error_at"] is None


def test_column_order_separator_and_null_file_names(spark):
    lines = [(1, None, 2, "amount\ttxn_id\tcategory\ttxn_date\taccount", ""), (2, None, 3, "3\tT\tc\t2026-01-02\tA", ""), (3, "only header", 1, HEADER, ""), (4, None, 1, "#x", "")]
    lines += [(5, "g", 1, "txn_id;account;amount;txn_date;category", ""), (6, "g", 2, "T;A;2;;c", ""), (6, "g", 2, "T;A;2;;c", "")]
    df = parse_records(spark.createDataFrame(lines, "line_id long, file_name string, line_no int, raw_line string, names string"), COLUMNS)
    got = sorted(tuple(r) for r in df.drop("error_at").collect())
    assert got == [(2, None, "T", "A", 3.0, dt.date(2026, 1, 2), "c"), (6, None, "T", "A", 2.0, None, "c"), (6, None, "T", "A", 2.0, None, "c")]


def test_many_blocks_of_one_file(spark):
    lines = [(i, "f", i, HEADER if i == 1 else f"T{i},A,{i},2026-01-01,c") for i in range(1, 400)]
    df = spark.createDataFrame(lines, "line_id long, file_name string, line_no int, raw_line string")
    out = parse_records(df, COLUMNS, block=10, salts=7).collect()
    assert sorted(r["line_id"] for r in out) == list(range(2, 400)) and all(r["amount"] == r["line_id"] for r in out)


def test_empty_table(spark):
    df = parse_records(spark.createDataFrame([], "line_id long, file_name string, line_no int, raw_line string"), COLUMNS)
    assert df.count() == 0 and df.columns == ["line_id", "reason", "error_at", *COLUMNS]


@pytest.mark.parametrize("span", [5, 16, 1000])
def test_raw_files_in_ranges(spark, tmp_path, span):
    records = ["a,b", 'x,"line\nbreak, here"', "", "1,2,3", '"q""\n\n""",end', "tail"]
    path = tmp_path / "raw.csv"
    path.write_text("\n".join(records))
    got = tokenize_ranges(spark, [(str(path), path.stat().st_size)], span=span).orderBy("start").collect()
    assert [r["raw"] for r in got] == records
    assert tokenize_ranges(spark, [], span=span).count() == 0


def test_a_quote_never_closed_comes_in_bounded_parts(spark, tmp_path):
    path = tmp_path / "open.csv"
    text = "a,b\n1,é\n" + '2,"' + "é\n," * 500
    path.write_text(text)
    got = tokenize_ranges(spark, [(str(path), path.stat().st_size)], span=64, most=200).orderBy("start", "part").collect()
    assert [r["raw"] for r in got[:2]] == ["a,b", "1,é"]
    rest = got[2:]
    assert "".join(r["raw"] for r in rest) == text[8:] and len(rest) > 5 and max(len(r["raw"].encode()) for r in rest) <= 400
    assert [r["part"] for r in rest] == list(range(len(rest))) and [r["more"] for r in rest] == [True] * (len(rest) - 1) + [False]


def test_records_that_begin_behind_the_head(spark, tmp_path):
    path = tmp_path / "head.csv"
    path.write_text('a "note\nk,v\n1,x\n2,"y\ny"\n')
    got = tokenize_ranges(spark, [(str(path), path.stat().st_size, 8)], span=5).orderBy("start").collect()
    assert [r["raw"] for r in got] == ["k,v", "1,x", '2,"y\ny"']
