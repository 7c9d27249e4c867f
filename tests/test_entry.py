import os

import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s for s in o.values())
    for n in range(1, 8):
        assert any(k.startswith(f"p{n}_") for k in q)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["o_orderkey", "customer", "net", "size", "key", "day"]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "orders_enriched", "scd2_check"])
def test_queries_equal_their_sql(spark, name):
    import duckdb
    import __spark_entry__ as entry

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = entry.queries()[name](spark, SF)
    rel = db.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    assert sorted((tuple(cell(x) for x in r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(cell(r[i]) for i in order) for r in rel.fetchall()), key=repr)
