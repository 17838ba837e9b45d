import pytest
from pyspark.sql import functions as F

from folioweave import prompts, seams
from folioweave.config import Indexing
from folioweave.operators import pipelines
from folioweave.session import shared_folder
from folioweave.sources import writers

TEXT = "Anna met Carl by the mill. Carl sold Anna the boat on Monday. Then Dora came and Anna left the mill to Dora. "


class Failing(seams.StandIns):
    def answer(self, df):
        return seams.apply_texts(df, "prompt", "raw", lambda texts: 1 / 0).withColumn("raw", F.coalesce("raw", F.lit("Z")))


@pytest.fixture(scope="module")
def index(spark):
    books = spark.createDataFrame([("Set_1", TEXT * 30), ("Set_2", None), ("Set_3", "Emil wrote to Frida. " * 3), (None, TEXT)], "book_id string, book_text string")
    return pipelines.index_books(books, seams.StandIns(), Indexing(window=40, overlap=5))


QUESTIONS = [(1, "Set_1", "Where did Anna meet Carl?", ["by the mill", "in town", "at sea", "nowhere"], "A"), (2, "Set_1", "And the weather?", ["fair", "foul", "by the mill", "none"], "B"), (3, "Set_3", "Who wrote?", None, "Emil"), (4, "Set_9", "Anything?", ["a", "b", "c", "d"], "D")]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid bigint, book_id string, question string, options array<string>, ground_truth string")


def test_index(index):
    assert {r.book_id for r in index.chunks.collect()} == {"Set_1", "Set_3"}
    assert {r.entity for r in index.mentions.where("book_id = 'Set_1'").collect()} == {"anna", "carl", "dora", "then"}  # a day is no entity
    assert index.nodes.where("book_id = 'Set_1' AND level > 0").count() > 0 and index.nodes.where("book_id = 'Set_3' AND level > 0").count() == 0
    assert {(r.source, r.target) for r in index.edges.where("book_id = 'Set_1'").collect()} >= {("anna", "carl")}


def test_cached_relations_are_merged_with_new_ones(spark, index):
    one = index.mentions.where("book_id = 'Set_1'")
    cached = spark.createDataFrame([("Set_1", "L0_chunk_0", [("anna", "likes", "carl"), ("anna", "likes", "anna"), ("anna", "likes", "nobody")])], "book_id string, chunk_id string, items array<struct<source:string,relation:string,target:string>>")
    edges, results = pipelines.extract_relations(index.chunks, one, seams.StandIns(), cached)
    assert results.where("chunk_id = 'L0_chunk_0'").count() == 0 and results.where("items IS NULL").count() < results.count()
    assert [(r.source, r.target, r.weight) for r in edges.where("relation = 'likes'").collect()] == [("anna", "carl", 1.0)]
    assert edges.where("relation = 'next'").count() > 0


def test_adaptive_evaluation(spark, index, questions, tmp_path):
    found = {r.qid: r for r in pipelines.evaluate_adaptive(questions, index, seams.StandIns()).collect()}
    assert set(found) == {1, 2, 3, 4} and found[1].prediction == "A" and found[1].ground_truth_text == "by the mill"
    assert found[4].evidence == "" and found[4].retrieval_info.type == "none" and "Evidence: \n" in found[4].prompt
    assert found[3].prediction and TEXT[:20] in found[1].prompt
    done = spark.createDataFrame([("Set_1",)], "book_id string")
    assert {r.qid for r in pipelines.evaluate_adaptive(questions, index, seams.StandIns(), done=done).collect()} == {3, 4}
    assert {r.qid for r in pipelines.evaluate_adaptive(questions, index, seams.StandIns(), mode="range", start=1, end=3).collect()} == {1, 2, 3}
    assert {r.prediction for r in pipelines.evaluate_adaptive(questions.where("qid < 3"), index, Failing()).collect()} == {"Z"}
    stored = writers.write_predictions(pipelines.evaluate_adaptive(questions.where("qid = 3"), index, seams.StandIns()).drop("prompt"), str(tmp_path), "C1")
    assert spark.read.parquet(stored).count() == 1


def test_region_evaluation(index, questions):
    found = {r.qid: r for r in pipelines.evaluate_region(questions, index, seams.StandIns()).collect()}
    assert set(found) == {1, 2, 3, 4} and found[1].retrieval_info.type in ("graph_traversal", "fallback_no_seeds", "fallback_no_candidates") and found[4].evidence == ""


def test_prompts(spark):
    row = spark.range(1).select(prompts.summary(1, F.lit("a {b}")).alias("x"), prompts.summary(2, F.lit(None).cast("string")).alias("y")).first()
    assert "a {b}" in row.x and row.x != row.y and "{text}" not in row.y


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError):
        shared_folder(Session())
