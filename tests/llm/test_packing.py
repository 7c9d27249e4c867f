import random

import pytest
from weirflow.llm.packing import TIERS, TOKENIZER, pack, placements, plan, token_counts, windows


def used(packed):
    out = {}
    for p in packed:
        for s, k in p.parts:
            out[s] = out.get(s, 0) + k * p.times
    return out


def first_fit(histogram, capacity):
    """Containers that first-fit decreasing takes."""
    rooms = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= s), None)
        if at is None:
            rooms.append(capacity - s)
        else:
            rooms[at] -= s
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_nothing_overflows(seed):
    r = random.Random(seed)
    histogram = {r.randint(1, 100): r.randint(1, 50) for _ in range(r.randint(1, 60))}
    packed = windows(histogram, 100, (25, 50, 100))
    assert used(packed) == histogram
    assert all(w.length <= w.tier for w in packed)
    patterns = plan(packed, 100)
    assert all(sum(packed[i].length * k for i, _, k in p.windows) <= 100 for p in patterns)
    laid = {}
    for p in patterns:
        for i, _, k in p.windows:
            laid[i] = laid.get(i, 0) + k * p.times
    assert laid == {i: w.times for i, w in enumerate(packed)}
    assert sum(p.times for p in patterns) <= first_fit(histogram, 100) * 1.05 + 1


def test_pieces_go_to_the_shortest_context_that_holds_them_and_fill_longer_ones():
    packed = windows({60: 2, 40: 1, 30: 1, 10: 5}, 100, (50, 100))
    assert [(w.tier, w.parts, w.times) for w in packed] == [(100, ((60, 1), (40, 1)), 1), (100, ((60, 1), (30, 1), (10, 1)), 1), (50, ((10, 4),), 1)]
    # three of these fit into a container, but only one into a window of its tier
    assert sum(p.times for p in plan(windows({30: 300}, 100, (50, 100)), 100)) == 100


def test_other_tiers_give_another_plan():
    r = random.Random(5)
    for histogram in ({s: r.randint(1, 30) for s in range(1, 2049)}, {r.randint(1, 300): 100 for _ in range(50)}, {r.randint(1, 2048): 3 for _ in range(200)}):
        made = [{(w.tier, w.parts, w.times) for w in windows(histogram, 2048, t)} for t in (TIERS, (2048,), (64, 128, 1000))]
        assert made[0] != made[1] != made[2] != made[0]
        counts = [sum(p.times for p in plan(windows(histogram, 2048, t), 2048)) for t in (TIERS, (2048,), (64, 128, 1000))]
        least = -(-sum(s * n for s, n in histogram.items()) // 2048)
        assert max(counts) <= least * 1.03 + 1


def test_plan_of_nothing():
    assert windows({}, 100) == [] and windows({0: 5}, 100) == []
    assert placements([], [])["containers"][0] == 0


def check(placed, sizes, capacity):
    by = {}
    for r in placed:
        by.setdefault(r["container"], []).append((r["at"], r["tokens"]))
    for c, parts in by.items():
        parts = sorted(p for p in parts if p[1])
        assert sum(n for _, n in parts) <= capacity
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert not parts or parts[-1][0] + parts[-1][1] <= capacity
    whole = {}
    for r in placed:
        whole.setdefault(r["key"], []).append((r["first_token"], r["tokens"]))
    for k, n in sizes.items():
        pieces = sorted(whole[k])
        assert sum(x for _, x in pieces) == n
        assert len(pieces) == max(1, -(-n // capacity))


def test_pack_places_every_text(spark):
    r = random.Random(3)
    sizes = {i: r.choice([1, 7, 7, 7, 7, 40, 99, 100, 101, 250, 0, r.randint(1, 100)]) for i in range(3000)}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()], "key long, tokens long, container string")
    placed = pack(df, 100, (25, 50, 100), group=4, rows_per_chunk=100).collect()
    check(placed, sizes, 100)
    costs = {}
    for p in placed:
        costs[p["step_group"]] = costs.get(p["step_group"], 0) + p["tokens"] ** 2
    full = sorted(costs.values())[1:]
    assert full[-1] < 1.3 * full[0]


def test_pack_odd_tables(spark):
    schema = "key long, tokens long"
    assert pack(spark.createDataFrame([], schema), 100).count() == 0
    only = pack(spark.createDataFrame([(1, 0), (2, None)], schema), 100).collect()
    assert {(r["key"], r["container"], r["tokens"]) for r in only} == {(1, -1, 0), (2, -1, 0)}
    twice = pack(spark.createDataFrame([(1, 60), (1, 60)], schema), 100).collect()
    assert sorted(r["container"] for r in twice) == [0, 1]


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    assert tiktoken
    texts = [(1, "It fits."), (2, None), (3, ""), (4, "Größe " * 4000)]
    try:
        got = {r["key"]: r["tokens"] for r in token_counts(spark.createDataFrame(texts, "id long, body string"), "id", "body", TOKENIZER).collect()}
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    assert got[1] == 3 and got[2] == got[3] == 0 and got[4] > 2048
