import json
import random

import pytest
from weirflow.operators.change_apply import current_state

LOG = "asset string, id long, op string, pk string, after string, record_key string"


def state(spark, log, assets=(("a", "k"),), mode="replace"):
    df = current_state(spark.createDataFrame(log, LOG), spark.createDataFrame(list(assets), "asset string, unique_key string"), mode)
    return {(r["asset"], r["record_key"]): (r["id"], r["fields"]) for r in df.collect()}


def brute(log, mode):
    by = {}
    for _, i, op, pk, after, _ in sorted(log, key=lambda x: x[1]):
        k = json.loads(pk)["k"]
        fields = json.loads(after) if after else {}
        if op[0].upper() == "D":
            by.pop(k, None)
        elif mode == "replace" or op[0].upper() == "I":
            by[k] = (i, {a: b for a, b in fields.items()})
        else:
            by[k] = (i, {**by.get(k, (0, {}))[1], **fields})
    return {("a", k): v for k, v in by.items()}


@pytest.mark.parametrize("mode", ["replace", "patch"])
@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, mode, seed):
    r = random.Random(seed)
    log = []
    for i in range(400):
        op = r.choice(["INSERT", "update", "U", "Delete ", "UPDATE", "UPDATE"])
        after = json.dumps({f: r.choice(["1", "2", None]) for f in r.sample("xyz", r.randint(1, 3))}) if op[0] not in "Dd" else None
        log.append(("a", i, op, json.dumps({"k": f"r{r.choice([0, 0, 0, 1, 2, 3, 4, 5])}"}), after, "clash"))
    want = brute(log, mode)
    log += r.sample(log, 80)
    r.shuffle(log)
    assert state(spark, log, mode=mode) == want


def test_odd_rows(spark):
    log = [
        ("a", 1, "I", '{"k": "x"}', None, ""),
        ("a", None, "I", '{"k": "y"}', "{}", ""),
        ("a", 2, "?", '{"k": "z"}', "{}", ""),
        ("a", 3, None, '{"k": "z"}', "{}", ""),
        ("a", 4, "I", "no json", "{}", ""),
        ("a", 5, "I", '{"k": null}', "{}", ""),
        ("other", 6, "I", '{"k": "x"}', "{}", ""),
        ("a", 7, "D", '{"k": "never seen"}', None, ""),
        ("a", 8, "u", '{"k": "late"}', '{"v": {"n": [1]}, "w": null}', ""),
        (None, 9, "I", '{"k": "x"}', "{}", ""),
    ]
    assert state(spark, log) == {("a", "x"): (1, {}), ("a", "late"): (8, {"v": '{"n":[1]}', "w": None})}


def test_composite_key_in_the_order_of_the_setting(spark):
    log = [("p", 1, "I", '{"b": "2", "a": "1"}', '{"v": 5}', ""), ("p", 2, "U", '{"a":"1","b":"2"}', '{"v": 6}', "")]
    assert state(spark, log, [("p", "a, b")]) == {("p", "1|2"): (2, {"v": "6"})}


def test_patches_that_set_nothing_give_no_state(spark):
    """The number of a record comes from its living fields, not from its last row in the log."""
    log = [("a", 1, "I", '{"k": "x"}', '{"v": 1, "w": 2}', ""), ("a", 2, "U", '{"k": "x"}', '{"v": 3}', ""), ("a", 3, "U", '{"k": "x"}', "{}", ""), ("a", 4, "U", '{"k": "x"}', None, "")]
    log += [("a", 5, "U", '{"k": "y"}', '{"v": 1}', ""), ("a", 6, "D", '{"k": "y"}', None, ""), ("a", 7, "U", '{"k": "y"}', None, "")]
    assert state(spark, log, mode="patch") == {("a", "x"): (2, {"v": "3", "w": "2"})}
    assert state(spark, log) == {("a", "x"): (4, {}), ("a", "y"): (7, {})}


def test_found_is_computed_by_fields(spark):
    df = current_state(spark.createDataFrame([("a", 1, "I", '{"k": "x"}', '{"v": 1}', "")], LOG), spark.createDataFrame([("a", "k")], "asset string, unique_key string")).select("asset", "record_key", "id")
    assert "max_by" in df._jdf.queryExecution().optimizedPlan().toString()


def test_empty_log_and_wrong_mode(spark):
    assert state(spark, []) == {}
    with pytest.raises(ValueError, match="mode"):
        state(spark, [], mode="x")
