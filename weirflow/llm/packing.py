"""Filling containers of fixed capacity with texts: packing by context sizes, one tier upon the other.

1. Each piece is routed to the shortest context (tier) that holds it; the longest context is the capacity.
2. Tiers are packed from the longest down, into windows of their own context: a window opens with the longest pieces of its tier.
3. The gap of a window is filled at once with the largest pieces of its own or any shorter tier that fit, so long windows
   use up short pieces before these are packed themselves.
4. Windows are laid into containers, longest content first; what a container has left takes the longest window that fits.
5. Containers are numbered by their attention cost (sum of squared lengths of pieces) and dealt to step groups in alternating
   direction, so the groups' costs are alike.

Everything is planned over the histogram of sizes: at most as many numbers as the capacity has, whatever the number of texts. One
combination of sizes (of windows) is used as often as the histogram allows at once. Spark then numbers the pieces
of each size and looks their place up in the plan.

Defined results of ``pack``:
* a text without tokens, or null, gets one piece of no tokens in container 0 (-1 if there is no other text);
* only a text over the capacity is divided: full pieces and one rest, each placed like any other;
* repeated rows are packed as often as they come; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.session import cut

#: Where the public vocabulary lies; a parameter of ``token_counts``.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TIERS = (256, 512, 1024, 2048)


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """key, tokens of every row. The vocabulary file (under 2 MB) goes to the executors once."""
    with open(tokenizer, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        encode = _encoder(vocabulary.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "tokens": [len(encode(t)) if t else 0 for t in b["text"]]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(count, f"key {kind}, tokens bigint")


@dataclass(frozen=True)
class Filled:
    """Sizes that fill one window of a context (size, how often), and how many windows are filled so."""

    tier: int
    parts: tuple[tuple[int, int], ...]
    times: int

    @property
    def length(self) -> int:
        return sum(s * k for s, k in self.parts)

    @property
    def cost(self) -> int:
        return sum(s * s * k for s, k in self.parts)


@dataclass(frozen=True)
class Pattern:
    """Windows that fill one container (number of the window's kind, first of it, how many a container), and how many containers are filled so."""

    windows: tuple[tuple[int, int, int], ...]
    times: int
    cost: int


def _combinations(left: dict[int, int], openers: list[int], room: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Take everything of ``openers`` out of ``left``, each combination opened by the largest of them and filled with the largest that fit; and how often each."""
    live, out = sorted(left), []
    own = sorted(openers)
    while own:
        fill: list[tuple[int, int]] = []
        free, most = room, own[-1]
        while free:
            at = bisect_right(live, min(free, most))
            if not at:
                break
            s = live[at - 1]
            k = min(free // s, left[s])
            fill.append((s, k))
            free, most = free - s * k, s - 1
        times = min(left[s] // k for s, k in fill)
        for s, k in fill:
            left[s] -= k * times
            if not left[s]:
                del left[s]
                live.remove(s)
                if s in openers:
                    own.remove(s)
        out.append((tuple(fill), times))
    return out


def windows(histogram: dict[int, int], capacity: int, tiers: tuple[int, ...] = TIERS) -> list[Filled]:
    """Windows that use every piece of the histogram, tier by tier from the longest."""
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    bounds = [0, *sorted({min(t, capacity) for t in tiers} | {capacity})]
    return [Filled(high, fill, times) for low, high in sorted(zip(bounds, bounds[1:]), reverse=True) for fill, times in _combinations(left, [s for s in left if low < s <= high], high)]


def plan(packed: list[Filled], capacity: int) -> list[Pattern]:
    """Containers that use every window, most costly first."""
    by_length: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(packed):
        insort(by_length.setdefault(w.length, []), (i, w.times))
    left = {n: sum(t for _, t in kinds) for n, kinds in by_length.items()}
    out: list[Pattern] = []
    spent = {n: 0 for n in left}
    starts = {n: [sum(t for _, t in kinds[:j]) for j in range(len(kinds) + 1)] for n, kinds in by_length.items()}
    for fill, times in _combinations(left, list(left), capacity):
        # windows of one length may be of several kinds: containers are cut where a kind ends
        cuts = {0, times}
        for n, k in fill:
            cuts |= {-(-(e - spent[n]) // k) for e in starts[n] if 0 < e - spent[n] < k * times} | {(e - spent[n]) // k for e in starts[n] if 0 < e - spent[n] < k * times}
        edges = sorted(cuts)
        for lo, hi in zip(edges, edges[1:]):
            inside: list[tuple[int, int, int]] = []
            for n, k in fill:
                first, last = spent[n] + lo * k, spent[n] + hi * k
                for (i, _), a, b in zip(by_length[n], starts[n], starts[n][1:]):
                    x, y = max(a, first), min(b, last)
                    if x < y:
                        # either one kind for all these containers, or several kinds in the only one
                        inside.append((i, x - a, (y - x) // (hi - lo)))
            out.append(Pattern(tuple(inside), hi - lo, sum(packed[i].cost * k for i, _, k in inside)))
        for n, k in fill:
            spent[n] += k * times
    return sorted(out, key=lambda p: (-p.cost, p.windows))


def placements(packed: list[Filled], patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each size, where its pieces go in the order of their number: key (size and first number), count (a window), each (windows a container), container, offset, length (of the window), tier."""
    # runs of windows of one kind, in the order of the kind: (first, container, windows a container, containers, offset)
    laid: list[list[tuple[int, int, int, int, int]]] = [[] for _ in packed]
    base = 0
    for p in patterns:
        offset = 0
        for i, first, k in p.windows:
            laid[i].append((first, base, k, p.times, offset))
            offset += packed[i].length * k
        base += p.times
    seen: dict[int, int] = {}
    rows = []
    for w, runs in zip(packed, laid):
        for _, container, k, times, offset in sorted(runs):
            inner = 0
            for s, count in w.parts:
                rows.append((s << 42 | seen.get(s, 0), count, k, container, offset + inner, w.length, w.tier))
                seen[s] = seen.get(s, 0) + count * k * times
                inner += s * count
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 7)
    return {n: a[:, i] for i, n in enumerate(("key", "count", "each", "container", "offset", "length", "tier"))} | {"containers": np.array([base])}


def pack(sizes: DataFrame, capacity: int = 2048, tiers: tuple[int, ...] = TIERS, group: int = 8, rows_per_chunk: int = 500_000) -> DataFrame:
    """key, piece, tokens, first_token, container, at (offset in the container), tier (context of its window), step_group. sizes: key, tokens."""
    cap = F.lit(capacity)
    pieces = sizes.select("key", F.coalesce("tokens", F.lit(0)).alias("tokens")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / cap) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.select("key", "piece", (F.col("piece") * cap).cast("bigint").alias("first_token"), F.greatest(F.least(F.col("tokens") - F.col("piece") * cap, cap), F.lit(0)).cast("bigint").alias("size"))
    pieces = cut(pieces, "pieces")
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    packed = windows(histogram, capacity, tiers)
    where = placements(packed, plan(packed, capacity))
    n = int(where["containers"][0])
    groups = max(1, -(-n // group))
    chunks = max(8, sum(histogram.values()) // rows_per_chunk)
    # pieces of one size are numbered in chunks, so a size that a third of all pieces share is spread
    spread = pieces.withColumn("chunk", F.pmod(F.xxhash64("key", "piece"), F.lit(chunks)).cast("int"))
    counts = spread.groupBy("size", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("chunk")) - F.col("n")).select("size", "chunk", "base")
    number = F.row_number().over(Window.partitionBy("size", "chunk").orderBy("key", "piece")) - 1
    numbered = spread.withColumn("number", number).join(counts, ["size", "chunk"]).select("key", "piece", "first_token", "size", (F.col("number") + F.col("base")).alias("number"))

    def place(batches):  # noqa: ANN001, ANN202
        for b in batches:
            size, no = b["size"].to_numpy(), b["number"].to_numpy()
            some = size > 0
            if len(where["key"]):
                at = np.maximum(np.searchsorted(where["key"], size << 42 | no, side="right") - 1, 0)
                nth, inner = np.divmod(no - (where["key"][at] & ((1 << 42) - 1)), where["count"][at])
                ahead, beside = np.divmod(nth, where["each"][at])
                container = np.where(some, where["container"][at] + ahead, 0)
                window = np.where(some, beside * where["length"][at], 0)
                offset = np.where(some, where["offset"][at] + window + inner * size, 0)
                tier = np.where(some, where["tier"][at], 0)
            else:
                container, offset, tier = np.full(len(b), -1), np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            turn, seat = container // groups, container % groups
            group_of = np.where(container < 0, -1, np.where(turn % 2 == 0, seat, groups - 1 - seat))
            yield b[["key", "piece"]].assign(tokens=size, first_token=b["first_token"], container=container, at=offset, tier=tier, step_group=group_of)

    kind = sizes.schema["key"].dataType.simpleString()
    return numbered.mapInPandas(place, f"key {kind}, piece int, tokens bigint, first_token bigint, container bigint, at bigint, tier bigint, step_group bigint")
