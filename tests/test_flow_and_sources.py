import datetime as dt
import gzip
import json
import os

import pytest
from weirflow.plans.flow import combine, lineage, parse_flow
from weirflow.registry import Registry
from weirflow.sources.discovery import Cursor, listed, local_files, object_files
from weirflow.sources.feeds import Api, event_rows
from weirflow.sources.files import Format, kind_of, read_file
from weirflow.sources.inference import infer, records_of, to_frame
from weirflow.sources.templates import render, substitute, template_function, template_functions


def test_flows():
    f = parse_flow("a >> [b, c] >> d << e")
    assert f.upstream == {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c", "e"], "e": []}
    assert f.order().index("d") == 4 and not f.optional
    assert parse_flow("x | y >> z").optional == {"z"} and parse_flow("x, y >> z").upstream["z"] == ["x", "y"]
    both = combine([parse_flow("x >> z"), parse_flow("y >> z >> w")])
    assert both.optional == {"z"} and both.upstream["z"] == ["x", "y"]
    for bad in ("a >>", ">> a", "a >> >> b", "[a, b >> c", "a b >> c", ""):
        with pytest.raises(ValueError):
            parse_flow(bad)
    with pytest.raises(ValueError, match="cycle: a >> b >> a|cycle"):
        parse_flow("a >> b >> a").order()


def test_lineage():
    assert lineage({"o": frozenset(["x", "y"]), "c": frozenset()}, {"u": ["x"], "v": ["x", "y"]}) == {"o": {"u": ["x"], "v": ["x", "y"]}, "c": {}}


def test_registry():
    r = Registry("thing")
    r.register("a")(1)
    with pytest.raises(ValueError, match="registered already"):
        r.register("a")(2)
    with pytest.raises(ValueError, match="no thing 'b'"):
        r.get("b")


def test_templates():
    assert substitute({"a": ["${A:-x}/${B}", 1], "c": "${C:-}"}, {"A": "v"}) == {"a": ["v/${B}", 1], "c": ""}
    day = dt.datetime.now(dt.timezone.utc)
    assert render("/d/{rdd()}/{today(format='yymmdd')}.csv", {}) == f"/d/{day:%Y/%m/%d}/{day:%y%m%d}.csv"

    @template_function
    def region(code="eu"):
        return code.upper()

    assert render("{region('us')}-{region()}", {}) == "US-EU"
    template_functions.remove("region")
    with pytest.raises(ValueError, match="unknown template function"):
        render("{nope()}", {})


def test_inference(spark):
    rows = [{"i": 1, "f": 1, "b": True, "d": "2026-01-01", "t": "2026-01-01T10:00:00", "s": "x", "o": [1], "n": None}, {"i": 2, "f": 2.5, "b": None, "d": "2026-01-02", "t": "2026-01-01", "s": "2026-01-01", "o": "y"}]
    got = infer(rows)
    assert {k: v["dtype"] for k, v in got.items()} == {"i": "int", "f": "float", "b": "bool", "d": "date", "t": "datetime", "s": "string", "o": "object", "n": "string"}
    assert got["b"]["nullable"] and not got["i"]["nullable"]
    df = to_frame(spark, rows)
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "d": "timestamp", "t": "timestamp", "s": "string", "o": "string", "n": "string"}
    assert df.first()["t"] == dt.datetime(2026, 1, 1, 10) and to_frame(spark, {"a": float("nan")}).first()["a"] is None
    assert to_frame(spark, []).count() == 0
    with pytest.raises(ValueError):
        records_of("text")


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("k,v,w\n1,été,N/A\n2,,3.5\n".encode("latin-1"))
    df = read_file(spark, str(p))
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "été", None, "a.csv"), (2, None, 3.5, "a.csv")]
    p = tmp_path / "b.txt"
    p.write_text("written today\nk|v\n1|'a|b'\n2|-\n")
    df = read_file(spark, str(p), Format("f", "csv", {"delimiter": "|", "skip_header": 1, "quote_char": "'", "null_if": ["-"]}))
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "a|b", "b.txt"), (2, None, "b.txt")]
    (tmp_path / "c.csv").write_text("k,v\n")
    assert read_file(spark, str(tmp_path / "c.csv")).count() == 0
    for bad in ("x.doc", "x"):
        with pytest.raises(ValueError, match="unsupported"):
            kind_of(bad)
    with pytest.raises(ValueError, match="unknown type"):
        Format("f", "avro")


def test_encoding_is_each_files_own_and_of_all_its_bytes(spark, tmp_path):
    folder = tmp_path / "in.csv"
    folder.mkdir()
    filler = "".join(f"{i},{'x' * 100}\n" for i in range(12_000))  # over 1 MB of ASCII
    (folder / "a late.csv").write_bytes(("k,größe\n" + filler + "-1,été\n").encode("latin-1"))
    (folder / "b.csv").write_bytes("k,größe\n-2,été\n".encode())
    (folder / "c.csv").write_bytes("k,größe\n-3,ascii\n".encode("latin-1"))
    df = read_file(spark, str(folder))
    assert df.columns == ["k", "größe", "file_name"] and df.count() == 12_003
    assert [tuple(r)[:2] for r in df.filter("k < 0").orderBy("k").collect()] == [(-3, "ascii"), (-2, "été"), (-1, "été")]
    (tmp_path / "h.csv").write_bytes(("k,v\n" + filler + "-1,été\n").encode("latin-1"))
    assert read_file(spark, str(tmp_path / "h.csv")).filter("k < 0").first()["v"] == "été"
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress("k,v\n1,été\n".encode()))
    assert read_file(spark, str(tmp_path / "z.csv.gz")).first()["v"] == "été"
    (tmp_path / "s.txt").write_bytes("top\nk,v\n1,été\n".encode("latin-1"))
    assert read_file(spark, str(tmp_path / "s.txt"), Format("f", "csv", {"skip_header": 1})).first()["v"] == "été"


def test_line_breaks_in_quotes_and_headers_of_their_own(spark, tmp_path):
    from weirflow.sources.files import csv_files, read_csv

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('k,v\n1,"two\nlines, and ""quotes"""\n2,plain\n')
    (folder / "b.csv").write_text("v,k\nother order,3\n")
    (folder / "c.csv").write_text("k,v,more\n4,x,yy\n")
    df = read_csv(spark, str(folder), span=7)
    assert [tuple(r) for r in df.orderBy("k").collect()] == [
        (1, 'two\nlines, and "quotes"', None, "a.csv"), (2, "plain", None, "a.csv"), (3, "other order", None, "b.csv"), (4, "x", "yy", "c.csv"),
    ]
    assert [f.breaks for f in csv_files(spark, str(folder))] == [True, False, False]
    plain = tmp_path / "plain.csv"
    plain.write_text("k,v\n" + "".join(f"{i},x\n" for i in range(1000)))
    assert read_csv(spark, str(plain)).count() == 1000
    skipped = tmp_path / "s.csv"
    skipped.write_text('made by "us\nk,v\n1,"a\nb"\n')
    assert [tuple(r)[:2] for r in read_csv(spark, str(skipped), {"skip_header": 1}).collect()] == [(1, "a\nb")]
    (tmp_path / "open.csv").write_text('k,v\n1,"never closed\n2,x\n')
    assert read_csv(spark, str(tmp_path / "open.csv")).count() == 1  # as any reader takes it: one record to the end
    with pytest.raises(ValueError, match="skipped"):
        read_csv(spark, str(skipped), {"skip_header": 1, "delimiter": "||"})


def test_json_and_parquet(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    assert [tuple(r) for r in read_file(spark, str(tmp_path / "a.json")).orderBy("k").collect()] == [(1, "a.json"), (2, "a.json")]
    (tmp_path / "l.json").write_text('{"k": 1}\n{"k": 2}\n')
    assert read_file(spark, str(tmp_path / "l.json"), Format("f", "json", {"lines": True})).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"columns": ["a"], "data": [[1], [2]]}))
    assert read_file(spark, str(tmp_path / "s.json"), Format("f", "json", {"orient": "split"})).count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"a": {"0": 1, "1": 2}}))
    assert [r["a"] for r in read_file(spark, str(tmp_path / "c.json"), Format("f", "json", {"orient": "columns"})).collect()] == [1, 2]
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert read_file(spark, str(tmp_path / "p.parquet")).filter("file_name IS NOT NULL").count() == 3


def test_discovery(spark, tmp_path):
    for n in ("b.csv", "a.csv", "x.txt"):
        (tmp_path / n).write_text(n)
    seen = Cursor()
    assert [os.path.basename(p) for p in seen.fresh(local_files(str(tmp_path), "*.csv", "checksum"))] == ["a.csv", "b.csv"]
    assert seen.fresh(local_files(str(tmp_path), "*.csv", "checksum")) == []
    (tmp_path / "a.csv").write_text("new")
    assert [os.path.basename(p) for p in seen.fresh(local_files(str(tmp_path), "*.csv", "checksum"))] == ["a.csv"]
    assert len(local_files(str(tmp_path), "*.csv", keep=lambda p: p.endswith("b.csv"))) == 1 and local_files(str(tmp_path / "none")) == []
    with pytest.raises(ValueError):
        local_files(str(tmp_path), strategy="size")
    assert listed(spark, str(tmp_path), "*.csv", checksum=True).count() == 2

    class Client:
        def get_paginator(self, _):
            return self

        def paginate(self, **_):
            return [{"Contents": [{"Key": "in/b.csv", "ETag": '"2"'}, {"Key": "in/", "ETag": '"0"'}]}, {"Contents": [{"Key": "in/a.csv", "ETag": '"1"'}]}, {}]

    assert object_files(Client(), "bk", "in/", "*.csv") == [("s3a://bk/in/a.csv", {"etag": "1"}), ("s3a://bk/in/b.csv", {"etag": "2"})]


class Response:
    def __init__(self, payload, ok=True):
        self.payload, self.ok = payload, ok

    def json(self):
        return self.payload

    def raise_for_status(self):
        if not self.ok:
            raise OSError("HTTP 500")


def test_api_and_events(spark):
    api = Api("http://h/", send=lambda method, url, **_: Response([{"m": method, "u": url}]))
    assert tuple(api.rows(spark, "/x", "POST").first()) == ("POST", "http://h/x") and api.healthy("x", "HEAD")
    assert not Api("http://h", send=lambda *a, **k: Response([], ok=False)).healthy("x")
    with pytest.raises(OSError):
        Api("http://h", send=lambda *a, **k: Response([], ok=False)).rows(spark, "x")
    with pytest.raises(ValueError):
        api.rows(spark, "x", "DELETE")

    class Queue:
        def consume(self, event_type):
            return [{"event_type": event_type, "n": 1}] if event_type == "click" else []

    assert event_rows(spark, Queue(), "click").count() == 1 and event_rows(spark, Queue(), "none").count() == 0


def test_connections(spark, tmp_path, monkeypatch):
    from weirflow.operators.tables import TableStore
    from weirflow.plans.pipeline import Runner
    from weirflow.plans.spec import build

    (tmp_path / "c.yaml").write_text("a: [1]")
    monkeypatch.setenv("S_KEY", "k")
    made = {"api": {"base_url": "http://h", "odd": 1}, "http": {"base_url": "http://h"}, "postgres": {"host": "db", "database": "d", "user": "u", "odd": 1}, "snowflake": {"account": "acc", "warehouse": "w"}, "config": {"path": str(tmp_path / "c.yaml")}, "logger": {"level": "warning"}, "vault": {"prefix": "S_"}, "ftp": {}}
    r = Runner(spark, build({"resources": [{"name": k, "type": k, "config": c} for k, c in made.items()]}), TableStore(spark, str(tmp_path)))
    assert r.connection("api").base_url == "http://h" and r.connection("http") is r.connection("http")
    assert r.connection("postgres").url == "jdbc:postgresql://db:5432/d" and r.connection("snowflake").properties["warehouse"] == "w"
    assert r.connection("config") == {"a": [1]} and r.connection("logger").level == 30 and r.connection("vault")("KEY") == "k"
    with pytest.raises(KeyError):
        r.connection("vault")("NONE")
    for bad in ("ftp", "absent"):
        with pytest.raises(ValueError):
            r.connection(bad)


def test_a_database_in_the_driver_on_a_cluster(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    code = """
import datetime as dt
from decimal import Decimal
from pyspark.sql import SparkSession
from weirflow.sources.connections import Jdbc

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
db = Jdbc("jdbc:derby:memory:here;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
schema = "id long, name string, of double, day date, at timestamp, much decimal(10,2), big boolean"
row = lambda i: (i, None if i % 7 == 0 else f"n'{i}", i / 4, dt.date(2026, 1, 1 + i % 28), dt.datetime(2026, 1, 1, 3, i % 60), Decimal(i) / 4, i % 2 == 0)
rows = [row(i) for i in range(25_000)]
more = [(i, f"m{i}") for i in range(25_000, 25_004)]
db.write(spark.createDataFrame(rows, schema).repartition(3), "t", mode="overwrite", partitions=2)
db.write(spark.createDataFrame(more, "id long, name string"), "t", ["name", "id"])
db.write(spark.createDataFrame(more, "id long, name string"), "t", mode="ignore")
got = db.read(spark, "t", "id", 0, 25_004, 2)
assert [tuple(r) for r in got.orderBy("id").collect()] == rows + [(*m, None, None, None, None, None) for m in more], got
db.write(spark.createDataFrame(more, "id long, name string").limit(0), "t", mode="overwrite")
assert db.read(spark, "t").collect() == [] and got.count() == 25_004
try:
    db.write(spark.createDataFrame(more, "id long, name string"), "t", mode="error")
    raise SystemExit("written over")
except Exception as e:
    assert "already exists" in str(e) or "ALREADY_EXISTS" in str(e), e
print("reached")
"""
    code = code.replace(".getOrCreate()", f'.config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.session.timeZone", "UTC").getOrCreate()', 1)
    home = tmp_path / "home"  # executors write to work in Spark's home
    (home / "work").mkdir(parents=True)
    for f in Path(pyspark.__file__).parent.iterdir():
        if f.name != "work":
            (home / f.name).symlink_to(f)
    env = {**os.environ, "PYTHONPATH": str(Path(__file__).resolve().parents[1]), "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "TZ": "UTC"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("reached"), done.stderr[done.stderr.find("Traceback") :][:3000]
