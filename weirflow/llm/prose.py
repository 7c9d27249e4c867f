"""Per-document text statistics, and how far each text lies from the prose of its language.

1. Pair counts of letters over all texts give the bits that each letter of a word costs (random letters are dear), and the
   letters of each script say which scripts the texts hold enough of to judge words by them.
2. Per text sixteen statistics are computed in one pass, and its language is told by the common words it holds.
3. Per language, mean and covariance of prose are estimated robustly over all texts: from medians and
   deviations, then twice from the texts within a cutoff of the estimate before (most texts are prose).
4. The squared Mahalanobis distance of every text is reported with each statistic's share in it. A text is an outlier if its
   distance is beyond the quantile ``GATE`` of the chi-square distribution. What kind of outlier follows from the statistics
   that make it one: each kind has its evidence (``EVIDENCE``), and the kind whose statistics alone lie farthest beyond
   their own quantile is told. An outlier by style only (long words, short lines, capitals, few common words) stays prose.

A statistic that can't be judged is left out of the distance, which then has fewer degrees of freedom: common words where no
language is told, and the cost and readability of words in scripts that the texts hardly hold or that write no blanks.
Such texts are held against the prose of all languages together.

What leaves the executors are letter pairs (a fixed alphabet squared), letters by script, and sums per language (a matrix each).

Defined results of ``outliers``: null or blank texts have null statistics and no kind; texts of unknown languages are told as "";
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import cut

STATISTICS = [
    "log_words", "mean_word", "mixed", "digits", "symbols", "uppercase", "end_punctuation", "common_words",
    "log_line_words", "row_lines", "item_lines", "distinct_words", "letter_bits", "readable", "repeated", "log_longest",
]
AT = {n: i for i, n in enumerate(STATISTICS)}
#: Least standard deviations: differences below these steps aren't told apart.
FLOOR = np.array([0.5, 0.4, 0.1, 0.03, 0.04, 0.1, 0.2, 0.08, 0.4, 0.13, 0.13, 0.1, 0.3, 0.1, 0.15, 0.3])
#: The statistics that tell each kind.
EVIDENCE = {"table": ["row_lines"], "list": ["item_lines"], "junk": ["mixed", "letter_bits", "readable", "repeated"]}
#: Quantiles of the chi-square distribution: outliers lie beyond ``GATE``, the evidence of a kind beyond ``PROOF``, and texts within ``TRIM`` go into mean and covariance.
GATE, PROOF, TRIM = 0.95, 0.999, 0.999
#: Letters are told apart by their base: a to z, one code for all scripts without blanks, and 200 codes that the other scripts share.
WORDLESS, OTHER, WIDTH = 27, 28, 228
_BASE = {"ø": "o", "ł": "l", "đ": "d", "ß": "s", "æ": "a", "œ": "o", "þ": "t", "ð": "d", "ı": "i"}
_NO_BLANKS = {"CJK", "HIRAGANA", "KATAKANA", "BOPOMOFO", "YI", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN"}
#: A script that holds a smaller share of all letters than this isn't known.
KNOWN = 0.002
#: A language is told from this share of common words on.
TOLD = 0.15
#: A word whose letters cost more bits than this on average is no word of any language here.
WORD_BITS = 6.3

BULLET = re.compile(r"^\s*(?:[-*+•✓✔☑·‣◦–—>→]+|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
ROW_MARK = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
CELL_TAG = re.compile(r"<[^>]*>")
RULER = re.compile(r"[\s|:+=-]{5,}")
SPLITS = [(re.compile(r"\t+"), 3), (re.compile(r"\|"), 2), (re.compile(r";"), 3), (re.compile(r" {3,}"), 2), (re.compile(r"\.{4,}|\s/\s"), 2), (re.compile(r","), 4)]
SENTENCE_END = ".!?…\"”»)’。؟۔।"
CLOSED = (".", "!", "?", "。", "؟", "۔", "।")


class _Formats(dict):
    """Table for str.translate that drops format characters, filled as characters come."""

    def __missing__(self, c: int):  # noqa: ANN204
        self[c] = None if unicodedata.category(chr(c)) == "Cf" else c
        return self[c]


_formats = _Formats()


def clean(text: str) -> str:
    """Compatible forms of characters, without format characters."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text).translate(_formats)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """For each character of the basic plane: its code (0: no letter), flags letter 1, digit 2, uppercase 4, space 8, sign 16, and script; and the names of scripts."""
    code, flags, script = (np.zeros(1 << 16, dtype=np.uint8) for _ in range(3))
    names: dict[str, int] = {"": 0}
    for i in range(1 << 16):
        c = chr(i)
        sign = i > 127 and unicodedata.category(c) in ("Sc", "Sm", "Sk", "Co")
        flags[i] = c.isalpha() | c.isdigit() << 1 | c.isupper() << 2 | c.isspace() << 3 | sign << 4
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c.lower())[0]
            base = _BASE.get(base, base)
            own = (unicodedata.name(base, "") or "OTHER").split(" ")[0]
            own = "CJK" if own in ("HIRAGANA", "KATAKANA") else own
            script[i] = names.setdefault(own, min(len(names), 255))
            code[i] = ord(base) - 96 if "a" <= base <= "z" else WORDLESS if own in _NO_BLANKS else OTHER + ord(base) % (WIDTH - OTHER)
    return code, flags, script, list(names)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts behind each other (beyond the basic plane as one symbol), and where each text begins."""
    starts = np.cumsum([0, *map(len, texts)])
    p = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(p < 1 << 16, p, 0x2BFF).astype(np.uint16), starts


def letter_pairs(p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters, and for each the index of the pair with the character before it (0 before a word)."""
    code = _characters()[0][p]
    before = np.zeros_like(code)
    before[1:] = code[:-1]
    before[starts[:-1][starts[:-1] < len(code)]] = 0
    at = np.flatnonzero(code)
    return at, before[at].astype(np.int32) * WIDTH + code[at]


def slices(texts: list[str], most: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of together about so many characters (one text at least)."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((lo, i))
            lo, size = i, 0
        size += len(t)
    return [*out, (lo, len(texts))] if texts else []


def cells(line: str) -> list[str]:
    """The cells of a line that looks like a row; else nothing."""
    if ROW_MARK.search(line):
        return [c for c in CELL_TAG.split(line) if c.strip()] or [""]
    best: list[str] = []
    for split, least in SPLITS:
        parts = [c for c in split.split(line.strip()) if c.strip()]
        if len(parts) >= least and len(parts) > len(best):
            best = parts
    return best


def line_kinds(lines: list[str], common: frozenset[str]) -> tuple[int, int]:
    """How many lines are rows of several cells, and how many are short single items."""
    rows = items = 0
    for line in lines:
        marked = "<" in line and ROW_MARK.search(line) or RULER.fullmatch(line)
        if not marked and line.rstrip().endswith(CLOSED):
            continue
        body = BULLET.sub("", line).strip()
        found = WORD.findall(body.lower())
        if not marked and sum(w in common for w in found) >= 0.4 * max(1, len(found)):
            continue
        c = cells(line)
        if marked or (c and sum(len(x.split()) for x in c) <= 4 * len(c)):
            rows += 1
        elif len(body) < 60 and len(body.split()) <= 7 and not body.endswith("…"):
            items += 1
    return rows, items


def repeated_share(tokens: list[str], rounds: int = 6) -> float:
    """The share of pairs of tokens that repeat the pair one period before, for the best period, of any length, of at least so many rounds."""
    n = len(tokens)
    if n < rounds or len(set(tokens)) > 0.5 * n:
        return 0.0  # six rounds with at most 0.3 of other tokens leave fewer distinct ones
    number = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    ids = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=n)
    # periods are read off the distances between one pair of tokens and its next occurrence
    pair = ids[:-1] * n + ids[1:]
    by = np.argsort(pair, kind="stable")
    counts = np.bincount((by[1:] - by[:-1])[pair[by][1:] == pair[by][:-1]], minlength=1)[: n // rounds + 1]
    return max((float((pair[p:] == pair[:-p]).mean()) for p in np.argsort(counts)[-3:] if counts[p]), default=0.0)


def pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of letters, and letters by script."""
    counts, scripts = np.zeros(WIDTH * WIDTH, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for lo, hi in slices(texts):
        p, starts = points([clean(t) for t in texts[lo:hi]])
        counts += np.bincount(letter_pairs(p, starts)[1], minlength=WIDTH * WIDTH)
        scripts += np.bincount(_characters()[2][p], minlength=256)
    return counts, scripts


def bit_table(counts: np.ndarray) -> np.ndarray:
    """Bits of a letter after another, by pair."""
    m = counts.reshape(WIDTH, WIDTH) + 0.01
    return np.minimum(-np.log2(m / m.sum(axis=1, keepdims=True)), 20).ravel()


def known_scripts(scripts: np.ndarray) -> np.ndarray:
    """Which scripts the texts hold enough of, and that write words apart."""
    names = _characters()[3]
    share = scripts / max(1, scripts[1:].sum())
    return np.array([bool(n) and n not in _NO_BLANKS and share[i] >= KNOWN for i, n in enumerate(names)] + [False] * (256 - len(names)))


@dataclass
class Measure:
    """What texts need besides themselves: bits of letter pairs, known scripts, and common words by language."""

    bits: np.ndarray
    known: np.ndarray
    common: dict[str, frozenset[str]]

    def __post_init__(self) -> None:
        self.langs = sorted(self.common)
        self.usual = min(6.0, float((2.0**-self.bits * self.bits).reshape(WIDTH, WIDTH).sum(axis=1)[1:27].mean()))
        self.spoken: dict[str, list[str]] = {}
        for g in self.langs:
            for w in self.common[g]:
                self.spoken.setdefault(w, []).append(g)
        self.every = frozenset(self.spoken)

    def batch(self, texts: list[str | None], langs: list[str | None]) -> list[tuple[str, int, list[float]] | None]:
        """Language, number of lines and statistics of each text; None for blank ones."""
        out: list = []
        held = [clean(t) if t else "" for t in texts]
        for lo, hi in slices(held):
            out += self._slice(held[lo:hi], langs[lo:hi])
        return out

    def _slice(self, texts: list[str], langs: list[str | None]) -> list[tuple[str, int, list[float]] | None]:
        p, starts = points(texts)
        n = len(texts)
        owner = np.repeat(np.arange(n), np.diff(starts))
        flags = _characters()[1][p]

        def per_text(mask: np.ndarray) -> np.ndarray:
            return np.bincount(owner[mask], minlength=n)

        script = _characters()[2][p]
        letters, digits, upper, solid = (per_text((flags & k) > 0) for k in (1, 2, 4, 8))
        known = per_text(self.known[script])
        solid = np.diff(starts) - solid
        same = np.zeros(len(p), dtype=bool)
        same[1:] = (p[1:] == p[:-1]) & (owner[1:] == owner[:-1])
        same = per_text(same)
        # signs inside of words, as wrongly decoded text has them
        sides = np.pad(flags, 1, constant_values=8)
        inside = ((flags & 16) > 0) & ((sides[:-2] | sides[2:]) & 9 == 1)
        signs = np.bincount(owner[inside], minlength=n)
        at, pair = letter_pairs(p, starts)
        cost = self.bits[pair]
        total = np.bincount(owner[at], weights=cost, minlength=n)
        begins = np.flatnonzero(pair < WIDTH)
        if len(begins):
            size = np.diff(np.append(begins, len(pair)))
            fine = np.add.reduceat(cost, begins) <= WORD_BITS * size
            readable = np.bincount(owner[at[begins[fine]]], weights=size[fine], minlength=n)
            turns = np.zeros(len(at), dtype=bool)
            turns[1:] = (pair[1:] >= WIDTH) & (script[at[1:]] != script[at[:-1]])
            torn = np.logical_or.reduceat(turns, begins)
            mixed = np.bincount(owner[at[begins[torn]]], weights=size[torn], minlength=n)
        else:
            readable, mixed = np.zeros(n), np.zeros(n)
        mixed = np.minimum(mixed + 5 * signs, letters)
        return [
            self._one(t, g, *v) if t.strip() else None
            for t, g, *v in zip(texts, langs, letters.tolist(), digits.tolist(), upper.tolist(), solid.tolist(), same.tolist(), total.tolist(), readable.tolist(), mixed.tolist(), known.tolist())
        ]

    def _one(self, text: str, lang: str | None, letters: int, digits: int, upper: int, solid: int, same: int, cost: float, readable: float, mixed: float, known: int) -> tuple[str, int, list[float]]:
        lines = [x for x in text.split("\n") if x.strip()]
        tokens = text.split()
        found = WORD.findall(text.lower())
        n, m = max(1, len(found)), len(lines)
        seen = Counter(found)
        votes = dict.fromkeys(self.langs, 0)
        plain = 0
        for w in seen.keys() & self.every:
            plain += seen[w]
            for g in self.spoken[w]:
                votes[g] += seen[w]
        declared = (lang or "").strip().lower()[:2]
        told = max(self.langs, key=lambda g: (votes[g], g == declared)) if votes else ""
        told = told if told and votes[told] >= TOLD * n else ""
        if "://" in text or "www." in text:
            # addresses are no reading matter, whatever their letters
            readable -= sum(len(x) for x in tokens if "://" in x or x.startswith("www."))
        rows, items = line_kinds(lines, self.every)
        repeated = max(repeated_share(tokens), same / (len(text) - 1) if len(text) >= 12 else 0.0)
        distinct = len(seen) / n
        judged = not letters or known >= 0.5 * letters
        # shares of lines count two lines of prose besides, and costs of letters fifteen usual ones, so little text proves little
        return told, m, [
            math.log1p(len(found)), letters / n, mixed / max(1, letters), digits / solid, max(0.0, 1 - (letters + digits) / solid), upper / max(1, letters),
            sum(x.rstrip()[-1:] in SENTENCE_END for x in lines) / m, plain / n if told else math.nan, math.log1p(len(found) / m), rows / (m + 2), items / (m + 2),
            min(1.0, distinct * math.sqrt(n / 30)) if n > 30 else distinct, ((cost + 15 * self.usual) / (letters + 15) if letters else 12.0) if judged else math.nan,
            max(0.0, readable / solid) if judged else math.nan, repeated, math.log1p(max(map(len, tokens))),
        ]


def statistics(docs: DataFrame, common: dict[str, frozenset[str]]) -> DataFrame:
    """key, told (language), lines, stats (array) of every text (key, lang, text)."""
    texts = docs.select("text").filter("text IS NOT NULL")

    def pairs(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        total = np.zeros(WIDTH * WIDTH + 256, dtype=np.int64)
        for b in batches:
            total += np.concatenate(pair_counts(b["text"].tolist()))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at.astype(np.int32), "n": total[at]})

    counts = np.zeros(WIDTH * WIDTH + 256, dtype=np.int64)
    for r in texts.mapInPandas(pairs, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most the alphabet squared
        counts[r["pair"]] = r["n"]
    measure = Measure(bit_table(counts[: WIDTH * WIDTH]), known_scripts(counts[WIDTH * WIDTH :]), common)

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            out = measure.batch([t if isinstance(t, str) else None for t in b["text"]], [g if isinstance(g, str) else None for g in b["lang"]])
            yield pd.DataFrame({"key": b["key"], "told": [o[0] if o else None for o in out], "lines": [o[1] if o else 0 for o in out], "stats": [o[2] if o else None for o in out]})

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "lang", "text").mapInPandas(run, f"key {kind}, told string, lines int, stats array<double>")


def chi2(quantile: float, k: int) -> float:
    """The quantile of the chi-square distribution with k degrees of freedom (Wilson and Hilferty's cube)."""
    v = 2 / (9 * k)
    return k * (1 - v + NormalDist().inv_cdf(quantile) * math.sqrt(v)) ** 3


@dataclass
class Prose:
    """Mean and covariance of the prose of one language."""

    mean: np.ndarray
    cov: np.ndarray

    def contributions(self, x: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Each statistic's share in the squared distance of each row of x, over the statistics ``of`` only."""
        of = np.arange(len(self.mean)) if of is None else of
        out = np.zeros_like(x)
        d = x[:, of] - self.mean[of]
        out[:, of] = d * (d @ np.linalg.inv(self.cov[np.ix_(of, of)] + np.diag(FLOOR[of] ** 2)))
        return out

    def judge(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts with the same statistics missing (nan): shares, limit of the distance, and kind (None: prose)."""
        held = np.flatnonzero(~np.isnan(x[0]))
        shares = self.contributions(x, held)
        shares[:, np.isnan(x[0])] = np.nan
        names = list(EVIDENCE)
        proof = np.zeros((len(x), len(names)))
        for k, name in enumerate(names):
            of = np.array([AT[n] for n in EVIDENCE[name] if AT[n] in held])
            if len(of):
                toward = x[:, of] - self.mean[of]
                toward[:, [STATISTICS[i] == "readable" for i in of]] *= -1
                # only what points to the kind is evidence of it
                kept = np.where(toward > 0, x[:, of], self.mean[of])
                full = x.copy()
                full[:, of] = kept
                proof[:, k] = self.contributions(full, of)[:, of].sum(axis=1) / chi2(PROOF, len(of))
        limit = chi2(GATE, len(held))
        best = proof.argmax(axis=1)
        told = (np.nansum(shares, axis=1) > limit) & (proof.max(axis=1) > 1)
        return shares, np.full(len(x), limit), np.where(told, np.array(names, dtype=object)[best], None)


def stats_matrix(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The statistics of the texts that have any, missing ones as nan; and which texts these are."""
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(at), d), at


def robust_prose(measured: DataFrame, rounds: int = 2, shrink: float = 50) -> dict[str, Prose]:
    """Per language, from all texts: medians and deviations first, then mean and covariance of the texts within the gate. "": all languages together."""
    d = len(STATISTICS)
    held = measured.filter("stats IS NOT NULL")
    middle = held.groupBy("told").agg(*[F.percentile_approx(F.nullif(F.col("stats")[i], F.lit(math.nan)), [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(d)]).collect()
    prose: dict[str, Prose] = {}
    for r in middle:
        q = np.array([r[f"q{i}"] or [0.0, 0.0, 0.0] for i in range(d)], dtype=float)
        prose[r["told"]] = Prose(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2))
    limit = chi2(TRIM, d)
    spoken = any(prose.keys())
    for _ in range(rounds):
        now = dict(prose)

        def sums(batches):  # noqa: ANN001, ANN202
            total: dict[str, np.ndarray] = {}
            for b in batches:
                x, _ = stats_matrix(b.column("stats"), d)
                told = b.column("told").dictionary_encode()
                code = told.indices.to_numpy(zero_copy_only=False)
                whole = ~np.isnan(np.delete(x, [] if spoken else [AT["common_words"]], axis=1)).any(axis=1)
                for i, g in enumerate(told.dictionary.to_pylist()):
                    own = np.nan_to_num(x[(code == i) & whole])
                    own = own[now[g].contributions(own).sum(axis=1) <= limit]
                    one = np.hstack([np.ones((len(own), 1)), own])
                    total[g] = total.get(g, 0) + one.T @ one
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["told", "m"])

        parts = held.select("told", "stats").mapInArrow(sums, "told string, m array<double>")
        width = (d + 1) ** 2
        gathered = {r["told"]: np.array(r["m"]).reshape(d + 1, d + 1) for r in parts.groupBy("told").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(width)]).alias("m")).collect()}
        gathered = {g: m for g, m in gathered.items() if m[0, 0] >= 2}
        if not gathered:
            break
        every = _cov(sum(gathered.values()))
        for g, m in gathered.items():
            mean, cov = _cov(m)
            prose[g] = Prose(mean, (cov * m[0, 0] + every[1] * shrink) / (m[0, 0] + shrink))
        if spoken or "" not in gathered:
            prose[""] = Prose(*every)
    return prose


def _cov(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = m[0, 1:] / m[0, 0]
    return mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def outliers(docs: DataFrame, common: dict[str, frozenset[str]], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, told, lines, stats, distance (squared), limit, shares (of each statistic in it), kind (null: prose)."""
    picked = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    measured = cut(statistics(picked, common), "statistics")
    prose = robust_prose(measured)

    def run(batches):  # noqa: ANN001, ANN202
        d = len(STATISTICS)
        for b in batches:
            n = b.num_rows
            x, at = stats_matrix(b.column("stats"), d)
            told = b.column("told").dictionary_encode()
            code = told.indices.fill_null(-1).to_numpy(zero_copy_only=False)[at]
            shares = np.full((len(at), d), np.nan)
            limits = np.full(len(at), np.nan)
            kinds = np.full(n, None, dtype=object)
            missing = np.isnan(x) @ (1 << np.arange(d))
            for g, m in {*zip(code.tolist(), missing.tolist())}:
                own = np.flatnonzero((code == g) & (missing == m))
                shares[own], limits[own], kinds[at[own]] = prose[told.dictionary[g].as_py()].judge(x[own])
            held = b.column("stats").is_valid()
            offsets = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False) * d)]).astype(np.int32)
            parts = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.ravel(), from_pandas=True), mask=pc.invert(held))
            spread = lambda v: pa.array(np.bincount(at, v, n), mask=held.to_numpy(zero_copy_only=False) == 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "told", "lines", "stats")), spread(np.nansum(shares, axis=1)), spread(limits), parts, pa.array(kinds, pa.string())], names=["key", "told", "lines", "stats", "distance", "limit", "shares", "kind"])

    kind = picked.schema["key"].dataType.simpleString()
    return measured.mapInArrow(run, f"key {kind}, told string, lines int, stats array<double>, distance double, limit double, shares array<double>, kind string")
