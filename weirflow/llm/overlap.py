"""Evaluation texts inside training texts: winnowing fingerprints, joined and extended to the whole shared run.

Of all k-grams of words the least hash in every window of ``window`` consecutive k-grams is kept. Two texts that share
k + window - 1 words in a row share a whole window and so a fingerprint; with 6 and 7 that is every run of twelve words.
Each hit is extended word by word to both sides, and counts if the run is long enough.

1. Texts and items give their fingerprints, which are joined. Each item's fingerprints are repeated under a few salts,
   so one that a third of all texts hold is spread; a side that Spark finds small goes to all executors, whatever side that is.
2. The hits of one text and item are united by diagonal (position in the text less position in the item), before any text moves.
3. Each text with hits is read once more, and cut for each diagonal to the words that lie beside the item: never more words than the item has.
4. These are held against the item's words, and the longest run of equal words counts.

Words: markup tags are blanks, entities are decoded, invisible characters dropped, case, accents and width disregarded; words are
unbroken runs of letters or digits.

Defined results of ``shared_runs``: null, empty and shorter texts, and those without a key, share nothing; of a repeated key the longest run counts; texts that come twice are reported under each
id; an empty table on either side gives no rows; very long texts are read whole; other columns aren't read.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import cut

K, WINDOW = 6, 7
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z!?][^<>]*>", re.S)
WORD = re.compile(r"[^\W_]+")
_FACTOR = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], dtype=np.uint64)
#: Invisible characters: the format characters (Cf), and blanks and fillers without width (fixed values).
_DROP = {c: None for c in [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0]}


class _Fold(dict):
    """Table for str.translate, filled as characters come: drops marks and format characters."""

    def __missing__(self, c: int):  # noqa: ANN204
        kind = unicodedata.category(chr(c))
        self[c] = None if c in _DROP or kind in ("Cf", "Mn", "Me") else c
        return self[c]


_fold = _Fold()


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_fold)
        text = unicodedata.normalize("NFKD", text.casefold()).translate(_fold)
    return WORD.findall(text.casefold())


class Hashes(dict):
    """Word -> hash, for the words met lately."""

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = xxhash.xxh64_intdigest(w)
        return self[w]


def word_hashes(text: str | None, cache: dict[str, int]) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(cache.__getitem__, found), dtype=np.uint64, count=len(found))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all k-grams of word hashes."""
    n = len(h) - k + 1
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g += h[i : i + n] * _FACTOR[i]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return g


def fingerprints(h: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen k-gram hashes of one text and their positions."""
    n = len(h) - k + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = _grams(h, k)
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    at = np.unique(np.arange(len(views)) + views.argmin(axis=1))
    return g[at], at


def parts(texts: list[str], most: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of together about so many characters (one text at least)."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((lo, i))
            lo, size = i, 0
        size += len(t)
    return [*out, (lo, len(texts))] if texts else []


def joint_fingerprints(texts: list[np.ndarray], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of many texts at once: hashes, number of the text, position in it.

    k-grams that reach over a border are no candidates. Windows that do may add fingerprints to those of the single texts, never lose one.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    none = np.zeros(0, np.int64)
    h = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    n = len(h) - k + 1
    if n < window:
        return np.zeros(0, np.uint64), none, none
    owner = np.repeat(np.arange(len(texts)), size)
    g = _grams(h, k)
    whole = owner[:n] == owner[k - 1 :]
    g[~whole] = np.iinfo(np.uint64).max
    at = np.unique(np.arange(n - window + 1) + np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1))
    at = at[whole[at]]
    starts = np.concatenate([[0], np.cumsum(size)])
    return g[at], owner[at], at - starts[owner[at]]


def longest_run(equal: np.ndarray) -> tuple[int, int]:
    """Start and length of the longest (first) run of true values."""
    edges = np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return 0, 0
    k = int((stops - starts).argmax())
    return int(starts[k]), int(stops[k] - starts[k])


def _prints(texts: DataFrame) -> DataFrame:
    """key, print (signed), pos, size (words of the text) of every text (key, text)."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        cache = Hashes()
        for b in batches:
            keys, held = b["key"].to_numpy(), b["text"].tolist()
            for lo, hi in parts(held):
                hashes = [word_hashes(t, cache) for t in held[lo:hi]]
                g, owner, pos = joint_fingerprints(hashes)
                if len(g):
                    size = np.array([len(h) for h in hashes])
                    yield pd.DataFrame({"key": keys[lo:hi][owner], "print": g.view(np.int64), "pos": pos, "size": size[owner]})

    return texts.mapInPandas(run, f"key {texts.schema['key'].dataType.simpleString()}, print bigint, pos bigint, size bigint")


def _beside(texts: DataFrame, item_kind: str) -> DataFrame:
    """The words of each text that lie beside an item, by diagonal. texts: key, text, hits (item, size, diagonal)."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        cache = Hashes()
        for b in batches:
            rows, held = [], 0
            for key, text, hits in b[["key", "text", "hits"]].itertuples(index=False):
                h = word_hashes(text, cache).view(np.int64)
                for x in hits:
                    lo = max(0, x["diagonal"])
                    own = h[lo : x["diagonal"] + x["size"]]
                    rows.append((key, x["item"], lo, lo - x["diagonal"], own))
                    held += len(own)
                    if held > 2_000_000:
                        yield pd.DataFrame(rows, columns=["key", "item", "at", "item_at", "words"])
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["key", "item", "at", "item_at", "words"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text", "hits").mapInPandas(run, f"key {kind}, item {item_kind}, at bigint, item_at bigint, words array<bigint>")


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        cache = Hashes()
        for b in batches:
            yield pd.DataFrame({"item": b["key"], "item_words": [word_hashes(t, cache).view(np.int64) for t in b["text"]]})

    return items.mapInPandas(run, f"item {items.schema['key'].dataType.simpleString()}, item_words array<bigint>")


def shared_runs(texts: DataFrame, items: DataFrame, least: int = K + WINDOW - 1, salts: int = 8) -> DataFrame:
    """key, item, start, length (in words of the text) of the longest run of at least ``least`` words of each pair that has one.

    texts, items: key, text. salts: under how many a fingerprint of the items is repeated.
    """
    if least < K + WINDOW - 1:
        raise ValueError(f"runs under {K + WINDOW - 1} words aren't guaranteed")
    texts, items = (x.select("key", "text").filter("text IS NOT NULL AND key IS NOT NULL") for x in (texts, items))
    kind, item_kind = texts.schema["key"].dataType.simpleString(), items.schema["key"].dataType.simpleString()
    # written once, so Spark knows how large they are
    theirs = cut(_prints(items).select(F.col("key").alias("item"), "print", F.col("pos").alias("item_pos"), F.col("size").alias("item_size")).distinct(), "fingerprints")
    theirs = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = _prints(texts).withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(salts)).cast("int"))
    hits = mine.join(theirs, ["print", "salt"]).select("key", "item", F.col("item_size").alias("size"), (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    held = hits.groupBy("key").agg(F.collect_list(F.struct("item", "size", "diagonal")).alias("hits"))
    beside = _beside(texts.join(held, "key"), item_kind).join(cut(_item_words(items), "item_words"), "item")

    def extend(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = []
            for key, item, at, item_at, own, other in b[["key", "item", "at", "item_at", "words", "item_words"]].itertuples(index=False):
                n = min(len(own), max(0, len(other) - item_at))
                start, length = longest_run(own[:n] == other[item_at : item_at + n])
                if length >= least:
                    rows.append((key, item, at + start, length))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "item", "start", "length"])

    runs = beside.mapInPandas(extend, f"key {kind}, item {item_kind}, start bigint, length bigint")
    best = F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("b")
    return runs.groupBy("key", "item").agg(best).select("key", "item", "b.start", "b.length")
