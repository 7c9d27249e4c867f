import os
import random

import numpy as np
import pytest
from weirflow.llm.prose import FLOOR, STATISTICS, Measure, Prose, bit_table, cells, chi2, known_scripts, line_kinds, outliers, pair_counts, repeated_share, slices

COMMON = {"en": frozenset("the a is it and of to was in for with this that my on not so but very".split())}
NOUNS = "kettle lamp zip motor cable lid screen handle base strap".split()
PROSE = ["The {0} is very good and it was in the box with the {1}.", "My {0} was not so good, but the {1} is fine for this price.", "It is the {0} that I like and this {1} was on my list to buy."]


def text(r):
    return " ".join(r.choice(PROSE).format(r.choice(NOUNS), r.choice(NOUNS)) for _ in range(r.randint(1, 8)))


def test_cells():
    assert cells("| a | b | c |") == [" a ", " b ", " c "]
    assert len(cells("<tr><td>x</td><td>y</td></tr>")) == 2
    assert cells("one plain sentence, with a comma") == []
    assert len(cells("Motor ....... 12 / n/a")) == 3


def test_line_kinds():
    assert line_kinds(["- kettle", "2) zip, small", "The lid is very good and it was in the box."], COMMON["en"]) == (0, 2)
    assert line_kinds(["a\tb\tc", "1\t2\t3"], COMMON["en"]) == (2, 0)


def test_repeated_share():
    assert repeated_share(["a"] * 20) == 1
    assert repeated_share(["well", "made"] * 20) == 1
    assert repeated_share("a phrase of nine words pasted over and over".split() * 12) == 1
    assert repeated_share("a sentence that comes thrice is no junk yet".split() * 3) == 0
    assert repeated_share("every word here is another one".split()) < 0.2


def test_letters_of_a_batch_are_those_of_each_text():
    texts = ["The café is OK", "zzz 12", "", None, "ÀÉ ÿ 漢字 😀"]
    counts, scripts = pair_counts([t for t in texts if t] * 3)
    m = Measure(bit_table(counts), known_scripts(scripts), COMMON)
    whole = m.batch(texts, ["en"] * 5)
    assert repr(whole) == repr([m.batch([t], ["en"])[0] for t in texts])
    assert whole[2] is None and whole[3] is None
    s = dict(zip(STATISTICS, whole[0][2]))
    assert s["mixed"] == 0 and s["uppercase"] == 3 / 11 and s["digits"] == 0
    assert [hi - lo for lo, hi in slices(["a" * 10, "b" * 3, "c" * 3, "d"], 6)] == [1, 2, 1]


def test_contributions_add_up_to_the_distance():
    r = np.random.default_rng(0)
    m = r.normal(size=(16, 16))
    p = Prose(r.normal(size=16), m @ m.T)
    x = r.normal(size=(5, 16))
    d, inverse = x - p.mean, np.linalg.inv(m @ m.T + np.diag(FLOOR**2))
    assert np.allclose(p.contributions(x).sum(axis=1), [v @ inverse @ v for v in d])
    x[:, 3] = np.nan
    shares, limit, _ = p.judge(x)
    assert np.isnan(shares[:, 3]).all() and limit[0] == chi2(0.95, 15)


def test_quantiles():
    assert chi2(0.95, 16) == pytest.approx(26.296, rel=0.005) and chi2(0.999, 4) == pytest.approx(18.467, rel=0.02)


def test_the_distance_decides():
    """The same evidence is no case where the distance over all statistics stays within its limit, and style alone is never one."""
    at = {n: i for i, n in enumerate(STATISTICS)}
    p = Prose(np.zeros(16), np.zeros((16, 16)))
    x = np.zeros((3, 16))
    x[:, at["row_lines"]] = 0.5  # beyond the quantile of its own, within that of sixteen
    x[1, at["log_words"]] = 3
    x[2, at["row_lines"]], x[2, at["mean_word"]] = 0, 100
    shares, limit, kind = p.judge(x)
    assert list(kind) == [None, "table", None]
    assert shares[0].sum() < limit[0] < shares[1].sum() < shares[2].sum()


FOREIGN = [
    "Вчера мы купили новый чайник для нашей кухни и остались очень довольны качеством этого товара.",
    "这个水壶非常好用，烧水很快，声音也不大，我和家人都很喜欢它，推荐大家购买。",
    "Αγόρασα αυτό το βραστήρα πριν από δύο εβδομάδες και είμαι πολύ ευχαριστημένος με την ποιότητά του.",
    "Kupiłem ten czajnik dwa tygodnie temu i jestem bardzo zadowolony z jego jakości, ponieważ szybko gotuje wodę i jest cichy.",
    "Bu su ısıtıcısını iki hafta önce aldım ve kalitesinden çok memnunum, suyu çabuk ısıtıyor ve sessiz çalışıyor.",
    "この電気ケトルはとても使いやすく、お湯がすぐに沸くので毎日使っています。",
    "هذه الغلاية جيدة جدا وتسخن الماء بسرعة وأنا سعيد بها كثيرا.",
]


def test_outliers(spark):
    r = random.Random(1)
    docs = [(i, "en", text(r)) for i in range(300)]
    docs += [(1000, "en", "- kettle\n- lamp\n- zip\n- motor (bad)\n- lid"), (1001, "xx", "kettle\t1\tgood\nlamp\t2\tbad\nzip\t3\tfine"), (1002, None, "xkqz wqrtp zzkx qqwv jxkz vvbq")]
    docs += [(1003, "en", "zip zip zip zip zip zip zip zip zip zip"), (1004, "en", "%$#@!^&*(%$#@!^&*(*&^%$"), (1005, "en", None), (1006, "en", "  \n "), (1007, "en", " ".join(text(r) for _ in range(2000))), (1008, "en", docs[0][2])]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, lang string, text string, kind string")
    got = {x["key"]: x for x in outliers(df, COMMON).collect()}
    assert len(got) == len(docs)
    assert {k: got[k]["kind"] for k in range(1000, 1009)} == {1000: "list", 1001: "table", 1002: "junk", 1003: "junk", 1004: "junk", 1005: None, 1006: None, 1007: None, 1008: None}
    assert not [k for k in range(300) if got[k]["kind"]]
    assert got[1005]["stats"] is None and got[1006]["distance"] is None
    assert got[1002]["distance"] > got[1002]["limit"] and abs(sum(x or 0 for x in got[1002]["shares"]) - got[1002]["distance"]) < 1e-6 * got[1002]["distance"]
    assert len(got[0]["stats"]) == len(STATISTICS)


def test_outliers_of_an_empty_table(spark):
    assert outliers(spark.createDataFrame([], "doc_id long, lang string, text string"), COMMON).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_prose_of_languages_and_scripts_that_the_texts_hardly_hold(spark):
    from weirflow.llm.queries import common_words

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    more = spark.createDataFrame([(-1 - i, None, t) for i, t in enumerate(FOREIGN)], docs.schema)
    got = outliers(docs.unionByName(more), common_words(spark, sf)).filter("key < 0").collect()
    assert len(got) == len(FOREIGN) and {r["kind"] for r in got} == {None} and {r["told"] for r in got} == {""}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_labelled_texts(spark):
    from weirflow.llm.queries import p10_found

    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r["kind"] for r in p10_found(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/doc_labels.parquet").collect()
    right = sum(found.get(r["doc_id"], "prose") == r["label"] for r in labels)
    assert right >= 0.95 * len(labels)
