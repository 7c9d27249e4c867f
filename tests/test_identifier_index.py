import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from weirflow.operators.identifier_index import IdentifierIndex, first_copies, id_array, known_in, surplus_copies

SCHEMA = "source string, identifier string, ord timestamp, row_id long, h1 string"


def brute(rows):
    best = {}
    for s, i, o, r, _ in rows:
        if i is not None:
            best[s, i] = min(best.get((s, i), (dt.datetime.max, 0)), (o or dt.datetime(9999, 1, 1), r))
    return {(s, r) for s, i, o, r, _ in rows if i is not None and best[s, i] != (o or dt.datetime(9999, 1, 1), r)}


@pytest.mark.parametrize(("seed", "batches", "merge_at"), [(0, 1, 9), (1, 5, 2), (2, 8, 3)])
def test_against_brute_force(spark, seed, batches, merge_at):
    r = random.Random(seed)
    day = dt.datetime(2026, 1, 1)
    rows = []
    for n in range(1500):
        i = None if r.random() < 0.05 else "hot" if r.random() < 0.33 else f"id{r.randint(0, 600)}"
        rows.append((r.choice("ab"), i, None if r.random() < 0.03 else day + dt.timedelta(hours=r.randint(0, 40)), n, "clash"))
    got = surplus_copies(spark.createDataFrame(rows, SCHEMA), batches, merge_at, rows_per_group=50).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == brute(rows)


def test_empty_and_null_only(spark):
    assert surplus_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert surplus_copies(spark.createDataFrame([("a", None, None, 1, "")] * 2, SCHEMA)).count() == 0
    assert surplus_copies(spark.createDataFrame([("a", "", None, 1, ""), ("a", "", None, 2, "")], SCHEMA)).collect()[0]["row_id"] == 2


def test_rows_without_a_number(spark):
    """A null row id counts as the highest, and large ones stay exact beside it."""
    day = dt.datetime(2026, 1, 1)
    big = 1 << 60
    rows = [("a", "x", day, None, ""), ("a", "x", day, big + 1, ""), ("a", "x", day, big, ""), ("a", "y", day, None, ""), ("a", "y", day, None, "")]
    got = sorted((tuple(r) for r in surplus_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([("a", None), ("a", big + 1), ("a", None)], key=repr)


def batch(spark, start, offset):
    return spark.range(start, start + 100).select(F.lit("s").alias("source"), F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), F.col("id").alias("ord"), (F.col("id") + offset).alias("row_id"))


def test_runs_are_immutable_and_merged(spark, tmp_path):
    index = IdentifierIndex(spark, f"file://{tmp_path}/i", bits=2, merge_at=2)
    for start in (0, 50, 100):
        index.absorb(batch(spark, start, start * 1000))
    assert index.merges == 2 and len(index.runs) == 1
    assert {r["row_id"] for r in index.surplus().collect()} == {x + 50_000 for x in range(50, 100)} | {x + 100_000 for x in range(100, 150)}


def test_an_index_outlives_its_session(spark, tmp_path):
    at = f"file://{tmp_path}/i"
    with pytest.raises(ValueError, match="no identifier index"):
        IdentifierIndex.open(spark, at)
    IdentifierIndex(spark, at, bits=1, merge_at=3).absorb(batch(spark, 0, 0))
    # a batch that was written, but not committed, is written again
    half = IdentifierIndex.open(spark, at)
    half._commit = lambda: None
    half.absorb(batch(spark, 50, 7000))
    other = IdentifierIndex.open(spark.newSession(), at)
    assert (other.bits, other.merge_at, other.batches) == (1, 3, 1) and other.surplus().count() == 0
    other.absorb(batch(spark, 50, 1000))
    last = IdentifierIndex.open(spark, at)
    last.absorb(batch(spark, 149, 2000))
    assert last.merges == 1 and {r["row_id"] for r in last.surplus().collect()} == {x + 1000 for x in range(50, 100)} | {2149}


def test_hot_identifiers_are_reduced_before_the_shuffle(spark, tmp_path):
    index = IdentifierIndex(spark, f"file://{tmp_path}/i", bits=1)
    rows = spark.range(0, 30_000, 1, 2).select(F.lit("s").alias("source"), F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2"), F.lit(0).cast("long").alias("ord"), F.col("id").alias("row_id"))
    index.absorb(rows)
    assert spark.read.parquet(f"{index.root}/local").filter("NOT surplus").count() == 2  # one a task
    assert index.surplus().count() == 29_999


def test_arrays():
    h1, h2 = np.array([1, -1, 5, 1]), np.array([0, 3, 256, 0])
    ids = id_array(h1, h2)
    run = np.sort(np.unique(ids))
    assert known_in(ids, run).all() and not known_in(id_array(np.array([1]), np.array([1])), run).any()
    assert not known_in(ids, run[:0]).any()
    assert first_copies(ids, np.array([5, 0, 0, 5]), np.array([2, 0, 0, 1])).tolist() == [False, True, True, True]
