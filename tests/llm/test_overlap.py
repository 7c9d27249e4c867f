import random

import numpy as np
import pytest
from weirflow.llm.overlap import Hashes, fingerprints, joint_fingerprints, longest_run, parts, shared_runs, word_hashes, words


def brute(texts, items, least=12):
    out = set()
    for k, t in texts:
        w = words(t)
        runs = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for j, s in items:
            v = words(s)
            if any(tuple(v[i : i + least]) in runs for i in range(len(v) - least + 1)):
                out.add((k, j))
    return out


def test_words():
    assert words("<p>Café&nbsp;<b>LA­TE</b>, ｆｕｌｌ 3½ é_x</p>") == ["cafe", "late", "full", "31", "2", "e", "x"]
    assert words("a < b and c > d") == ["a", "b", "and", "c", "d"]
    assert words(None) == [] and words("<br/>") == []
    assert words("STRASSE") == words("straße")


@pytest.mark.parametrize("seed", range(20))
def test_every_run_of_twelve_shares_a_fingerprint(seed):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(r.choice([2, 5, 50]))]
    run = [r.choice(voc) for _ in range(12)]
    a = [r.choice(voc) for _ in range(r.randint(0, 20))] + run + [r.choice(voc) for _ in range(r.randint(0, 20))]
    b = [r.choice(voc) for _ in range(r.randint(0, 20))] + run + [r.choice(voc) for _ in range(r.randint(0, 20))]
    c = Hashes()
    x, y = (fingerprints(word_hashes(" ".join(t), c))[0] for t in (a, b))
    assert set(x.tolist()) & set(y.tolist())


def test_fingerprints_of_many_texts_hold_those_of_each():
    r = random.Random(4)
    c = Hashes()
    texts = [word_hashes(" ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 3, 11, 12, 40]))), c) for _ in range(60)]
    g, owner, pos = joint_fingerprints(texts)
    got = set(zip(owner.tolist(), pos.tolist(), g.tolist()))
    for i, h in enumerate(texts):
        assert {(i, int(p), int(x)) for x, p in zip(*fingerprints(h))} <= got
    assert all(p + 6 <= len(texts[o]) for o, p, _ in got)
    assert [len(x) for x in joint_fingerprints([])] == [0, 0, 0]
    assert parts(["a" * 5, "b", "c" * 9, "d"], 6) == [(0, 2), (2, 3), (3, 4)]


def test_longest_run():
    assert longest_run(np.array([], dtype=bool)) == (0, 0) and longest_run(np.array([False, False])) == (0, 0)
    assert longest_run(np.array([True, False, True, True, False, True, True])) == (2, 2)


def fixture(seed=1):
    r = random.Random(seed)
    voc = [f"v{i}" for i in range(30)]
    items = [(100 + j, " ".join(r.choice(voc) for _ in range(r.randint(5, 60)))) for j in range(12)]
    texts = []
    for k in range(80):
        body = [r.choice(voc) for _ in range(r.randint(0, 60))]
        if k % 3 == 0:
            s = r.choice(items)[1].split()
            at = r.randint(0, max(0, len(s) - 5))
            body[len(body) // 2 : len(body) // 2] = s[at : at + r.choice([11, 12, 13, 40])]
        texts.append((k, " ".join(body)))
    texts += [(900, None), (901, ""), (902, texts[0][1]), (903, " ".join(voc * 3000) + " " + items[0][1])]
    return texts, [*items, (999, None)]


@pytest.mark.parametrize(("salts", "broadcast"), [(8, "10m"), (1, "-1"), (3, "-1")])
def test_shared_runs_against_brute_force(spark, salts, broadcast):
    texts, items = fixture()
    t = spark.createDataFrame([(k, x, 1) for k, x in texts], "key long, text string, item int")
    i = spark.createDataFrame(items, "key long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = shared_runs(t, i, salts=salts)
        found = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["key"], r["item"]) for r in found} == brute(texts, items) and len(found) == len(brute(texts, items))
    assert got.columns == ["key", "item", "start", "length"]
    by = dict(texts)
    held = dict(items)
    for r in found:
        run = words(by[r["key"]])[r["start"] : r["start"] + r["length"]]
        assert len(run) >= 12 and " ".join(run) in " ".join(words(held[r["item"]]))


def test_shared_runs_of_empty_tables(spark):
    texts, items = fixture()
    schema = "key long, text string"
    none = spark.createDataFrame([], schema)
    assert shared_runs(none, spark.createDataFrame(items, schema)).count() == 0
    assert shared_runs(spark.createDataFrame(texts, schema), none).count() == 0


def test_texts_without_key_and_repeated_keys(spark):
    schema = "key long, text string"
    run = " ".join(f"w{i}" for i in range(15))
    texts = spark.createDataFrame([(None, run), (1, "x " + run), (1, run + " y z"), (2, run)], schema)
    items = spark.createDataFrame([(None, run), (7, run), (7, run + " more")], schema)
    assert sorted((r["key"], r["item"], r["length"]) for r in shared_runs(texts, items).collect()) == [(1, 7, 15), (2, 7, 15)]


def test_shorter_runs_are_refused(spark):
    none = spark.createDataFrame([], "key long, text string")
    with pytest.raises(ValueError, match="aren't guaranteed"):
        shared_runs(none, none, least=11)
