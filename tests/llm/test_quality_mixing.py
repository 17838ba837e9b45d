import pytest
from pyspark.sql import functions as F

from folioweave.llm.mixing import mix, mixture_size
from folioweave.llm.quality import FIELDS, document_kinds, list_share, statistics, table_share

EN = {"en": frozenset("the of and to in a that was he for on with as his".split())}
PROSE = "The baker sold the old clock, and he went home by the back lane. Nobody had asked for it, as the road was still flooded.\n\n“Who moved the ladder?” called the tailor. The captain found a ring on the bridge.\n\n"
WRAPPED = "The baker sold the old clock, and he\nwent home by the back lane. Nobody had\nasked for it, as the road was still\nflooded. The captain found a ring on the\nbridge, and the matter was never raised\nagain."


COUNTS = lambda df: df.withColumn("n_tokens", F.when(F.col("text") != "", F.length("text")).otherwise(0))  # noqa: E731  any measure of size will do


def test_shares():
    assert list_share(["- one", "- two words", "* three"]) == 1.0 and list_share(["Contents", "1) a", "2) b", "3) c"]) == 1.0
    assert list_share(WRAPPED.split("\n")) < 0.85 and list_share(PROSE.strip().split("\n\n")) < 0.85
    assert table_share(["a,1,x", "b,2,y", "c,3,"]) == 1.0 and table_share(["| a | b |", "|---|---|", "| c | d |"]) == 1.0 and table_share(["a  1  x", "b  2  y"]) == 1.0
    assert table_share(WRAPPED.split("\n")) < 0.8 and table_share(["one"]) == 0.0


def test_statistics_of_odd_texts():
    for text in ["x", "!!!", "的", " .", "a\n\n\nb", "😀", "é" * 5000, "1234 5678"]:
        assert len(statistics(text, EN)) == 1 + len(FIELDS)


@pytest.mark.parametrize("text", ["a" * 1_000_000, " a" * 400_000, "的" * 400_000, "." * 400_000, "\n" * 400_000 + "x", "=" * 400_000, "a1" * 300_000, "“" * 300_000, "a " + " " * 1_000_000 + "b"])
def test_statistics_of_very_long_texts(text):
    import time

    began = time.time()
    statistics(text, EN)
    assert time.time() - began < 20


def test_kinds(spark):
    cases = {
        "prose": [PROSE * 2, WRAPPED, PROSE.upper(), PROSE.lower(), PROSE + "- a key\n- a ring\n\n" + PROSE],
        "list": ["Contents\n- the key\n- a grey ring\n- the old mill\n- a lantern", "\n".join(f"{i}) item number {i}" for i in range(1, 9)), "the red key\nan old ring\nCarl Winter, tailor\nthe mill\na lantern"],
        "table": ["name,page,fare\nkey,12,3.50\nring,14,\nmill,90,7.25\nrope,4,1.00", "| a | b |\n|---|---|\n| key | 3 |\n| ring | 4 |", "key\t1\t2\nring\t3\t4\nmill\t5\t6"],
        "junk": ["the " * 80, "ILLEGIBLE\n" * 30, "xqzt bcdfg hjklm npqrs tvwxz zxcvb qwrtp sdfgh jklmn bvcxz " * 3, "@#~ ^^1| !!a2 }{3 ;;:~ %%x1 ^~^ " * 8, '<div class="a"><span>key</span></div>' * 6, "h" + "aha" * 120],
    }
    rows = [(i, text, kind, 1.0) for i, (kind, text) in enumerate((k, t) for k, ts in cases.items() for t in ts)]
    rows += [(9000 + i, PROSE.replace("baker", f"baker number {i}") * (1 + i % 2), "prose", 1.0) for i in range(60)]
    rows += [(9900, None, None, 1.0), (9901, "", None, 1.0), (9902, " \n\t", None, 1.0), (None, "x", None, 1.0), rows[0]]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, expected string, outlier double")
    words = spark.createDataFrame([("en", w) for w in EN["en"]] + [(None, None)], "lang string, word string")
    found = {r.doc_id: r.kind for r in document_kinds(frame.select("doc_id", "text", "outlier"), words).collect()}
    assert found == {r[0]: r[2] for r in rows if r[0] is not None and r[2]}
    assert document_kinds(frame.where("false"), words).count() == 0
    assert document_kinds(frame.where("doc_id = 0"), words.where("false")).count() == 1


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, s, f"{word} number {i} and more words about {word}", 40 + (i * 7) % 30) for i, (s, word) in enumerate([("big", "ships")] * 200 + [("mid", "letters")] * 60 + [("small", "cooks")] * 10 + [("other", "noise")] * 20)]
    rows += [(900, "big", "", 0), (901, "big", None, 0), (0, "big", rows[0][2], rows[0][3])]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens bigint")


def test_mix(spark, sources):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.1, 3), ("missing", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixture, report = mix(sources, COUNTS, targets)
    rows = mixture.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "mid", "small"}
    assert all(1 <= r.copies <= {"big": 1, "mid": 1, "small": 3}[r.source] for r in rows)
    shares = {r.source: (r.actual_share, r.mixture_tokens, r.most_copies) for r in report.collect()}
    whole = sum(r.n_tokens * r.copies for r in rows)
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        used = sum(r.n_tokens * r.copies for r in rows if r.source == source)
        assert shares[source][1] == used and abs(used / whole - share / 0.9) < 0.02 and abs(shares[source][0] - used / whole) < 1e-6
    assert shares["missing"] == (0.0, 0, 0)
    assert sorted(map(tuple, mixture.collect())) == sorted(map(tuple, mix(sources, COUNTS, targets)[0].collect()))


def test_mix_of_nothing(spark, sources):
    targets = spark.createDataFrame([("big", 1.0, 2)], "source string, target_share double, max_repeats int")
    counts = COUNTS
    mixture, report = mix(sources.where("false"), counts, targets)
    assert mixture.count() == 0 and [tuple(r)[-2:] for r in report.collect()] == [(0.0, 0)]
    assert mix(sources, counts, targets.where("false"))[0].count() == 0
    one, _ = mix(sources, counts, targets)
    assert {r.copies for r in one.collect()} == {2}


def test_mixture_size():
    assert mixture_size({"a": (100.0, 2), "b": (100.0, 1)}, {"a": 0.5, "b": 0.5}) == 200.0 and mixture_size({}, {}) == 0.0


def test_rates_meet_both_sets_of_totals():
    import numpy as np

    from folioweave.llm.mixing import fit_rates

    rng = np.random.default_rng(1)
    own = np.repeat(np.arange(3), 20)
    tokens = rng.uniform(500, 2000, 60)
    soft = rng.dirichlet(np.ones(3), 60) + 2 * np.eye(3)[own]
    expected = tokens[:, None] * soft / soft.sum(axis=1, keepdims=True)
    goals = np.array([0.5, 0.3, 0.2]) * tokens.sum() * 0.6
    start = (goals / np.bincount(own, weights=tokens))[own]
    cap = np.full(60, 3.0)
    rate = fit_rates(tokens, expected, own, start, cap, goals)
    assert (rate >= 0).all() and (rate <= cap).all()
    assert np.abs(np.bincount(own, weights=rate * tokens) / goals - 1).max() < 0.01 and np.abs(rate @ expected / goals - 1).max() < 0.01
    tight = fit_rates(tokens, expected, own, start, np.full(60, 0.1), goals)
    assert np.allclose(tight, 0.1)  # a goal that no rates reach leaves all at their caps
