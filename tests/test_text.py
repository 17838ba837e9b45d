import pytest
from pyspark.sql import functions as F

from folioweave.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, clean",
    [("ﬁne  \t  print", "fine print"), ("Ｆｕｌｌ", "Full"), ("a\n\n\n\nb", "a\n\nb"), ("  x  ", "x"), ("", ""), (None, None)],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, X.clean_text) == clean


@pytest.mark.parametrize("raw, key", [("  “Mr.  X” ", "mr. x"), ("'Anna'", "anna"), ("", ""), (None, None)])
def test_entity_key(spark, raw, key):
    assert one(spark, raw, X.entity_key) == key


@pytest.mark.parametrize("raw, key", [("Mr. X", "x"), ("mr.", "mr"), ("Dr.  J. Doe", "j doe"), ("lady", "lady"), ("Lord  Byron", "byron")])
def test_relation_entity_key(spark, raw, key):
    assert one(spark, raw, X.relation_entity_key) == key


@pytest.mark.parametrize("name, kept", [("ab", False), ("abc", True), ("they", False), ("this", False), ("thistle", True)])
def test_is_entity(spark, name, kept):
    assert one(spark, name, X.is_entity) is kept


@pytest.mark.parametrize("raw, letter", [("A", "A"), ("b) x", "B"), ("Option C.", "C"), ("answer: d", "D"), ("maybe D is", "D"), ("none", "Z"), ("A cat", "A"), ("", "Z"), (None, "Z")])
def test_parse_answer(spark, raw, letter):
    assert one(spark, raw, X.parse_answer) == letter


def test_options(spark):
    assert one(spark, ["x", None, "z", "w", "v"], X.format_options, "array<string>") == "A. x\nB. \nC. z\nD. w\nE. v"
    assert one(spark, None, X.format_options, "array<string>") == ""
    assert one(spark, "chunk_3", X.chunk_key) == "L0_chunk_3" == one(spark, "L0_chunk_3", X.chunk_key)
    assert one(spark, "L1/a b", X.safe_id) == "L1_a_b"


def test_dense_query_without_options(spark):
    rows = spark.createDataFrame([("q", None), ("q", []), ("q", ["a"])], "question string, options array<string>")
    assert [r[0] for r in rows.select(X.dense_query(F.col("question"), F.col("options"))).collect()] == ["q", "q", "q\nA. a"]


def test_truth_text(spark):
    rows = spark.createDataFrame([("B", ["x", "y"], "f"), ("D", ["x"], "f"), (None, ["x"], "f"), ("?", None, None)], "l string, o array<string>, f string")
    assert [r[0] for r in rows.select(X.truth_text(F.col("l"), F.col("o"), F.col("f"))).collect()] == ["y", "f", "f", None]


def test_sentences(spark):
    assert one(spark, "One. Two!  Three?\nFour", X.sentences) == ["One.", "Two!", "Three?", "Four"]
