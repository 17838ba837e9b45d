import json

import pytest
from pyspark.sql import functions as F

from folioweave import seams
from folioweave.operators import metrics, search
from folioweave.sources import readers, writers
from folioweave.streaming import ingest


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l(spark):
    cases = [("the cat sat", "The cat  ran"), ("a b c d e", "b d a e"), ("", "x"), (None, "x"), ("x", "x"), ("p q", "r s")]
    rows = spark.createDataFrame(cases, "p string, t string")
    for r in rows.select("p", "t", metrics.rouge_l(F.col("p"), F.col("t")).alias("s")).collect():
        a, b = ("Z" if r.p is None else r.p).upper().split(), (r.t or "").upper().split()
        assert r.s == (round(2 * lcs(a, b) / (len(a) + len(b)), 4) if a and b else 0.0)


def test_exact_match_and_averages(spark):
    rows = spark.createDataFrame([("InfiniteChoice_1", "C1", "A", None, " a"), ("InfiniteChoice_1", "C2", "B", None, None), ("NarrativeQA_1", "C1", None, "The end", "the END ")], "book_id string, pipeline string, ground_truth string, ground_truth_text string, prediction string")
    scores = metrics.scored(rows)
    assert {(r.pipeline, r.n, r.em) for r in metrics.by_pipeline(scores).collect()} == {("C1", 2, 1.0), ("C2", 1, 0.0), ("all", 3, 0.666667)}
    assert {r.dataset: (r.em, r.rl) for r in metrics.averages(scores, "dataset").collect()} == {"InfiniteChoice": (0.5, 0.5), "NarrativeQA": (1.0, 1.0)}
    assert tuple(metrics.averages(scores.where(F.lit(False))).first()) == (0, 0.0, 0.0)


def test_answer_letter(spark):
    rows = spark.createDataFrame([(["x", "y"], "y", None), (["x"], "no", "x"), (["x"], "no", None), (["a", "b", "c", "d", "e"], "e", None)], "o array<string>, a string, f string")
    assert [r[0] for r in rows.select(readers.answer_letter(F.col("o"), F.col("a"), F.col("f"))).collect()] == ["B", "A", None, None]


def test_infinite_choice(spark, tmp_path):
    lines = [{"context": "two", "input": "q1", "options": ["a", "b", "c", "d"], "answer": "b"}, {"context": "one", "input": "q2", "options": ["a", "b", "c", "d"], "answer": ["d", "x"]}, {"context": "two", "input": "q3", "options": ["a", "b"], "answer": "none of them"}]
    path = tmp_path / "lines.jsonl"
    path.write_text("\n".join([json.dumps(lines[0]), "", "{broken", json.dumps(lines[1]), json.dumps(lines[2])]))
    books, qa = readers.load(spark, "InfiniteChoice", str(path))
    assert {(r.book_id, r.book_text) for r in books.collect()} == {("0", "two"), ("1", "one")}
    assert {(r.book_id, r.question_id, r.question, r.answer) for r in qa.collect()} == {("0", 0, "q1", "B"), ("1", 0, "q2", "D")}
    assert readers.broken_lines(spark, str(path)).count() == 1
    with pytest.raises(ValueError):
        readers.load(spark, "other", str(path))


def test_novel_qa(spark, tmp_path):
    for folder in ("Books/x", "Data/x"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "Books/x/B7.txt").write_text("text\nof it")
    (tmp_path / "Books/x/B8.txt").write_text("alone")
    (tmp_path / "Data/x/B7.json").write_text(json.dumps({"Q0": {"Question": "who", "Options": {"A": "a", "C": "c"}, "Gold": "C"}}))
    books, qa = readers.load(spark, "NovelQA", str(tmp_path))
    assert [(r.book_id, r.book_text) for r in books.collect()] == [("7", "text\nof it")]
    assert [(r.book_id, r.options, r.answer) for r in qa.collect()] == [("7", ["a", "", "c", ""], "C")]


def test_order_and_ranges(spark):
    ids = spark.createDataFrame([("10",), ("2",), ("x",), ("a",)], "book_id string")
    assert [r.book_id for r in readers.in_order(ids).orderBy("place").collect()] == ["2", "10", "a", "x"]
    rows = spark.createDataFrame([(i,) for i in range(5)], "book_no int")
    assert readers.run_range(rows, "single", 3).count() == 1 and readers.run_range(rows, "range", 1, 3).count() == 3 and readers.run_range(rows, "all").count() == 5
    with pytest.raises(ValueError):
        readers.run_range(rows, "some")


def test_writers(spark, tmp_path):
    root = str(tmp_path)
    edges = "book_id string, source string, relation string, target string, weight double, support_count int, chunk_ids array<string>"
    one = spark.createDataFrame([("b", "a", "r", "c", 1.0, 1, ["x"]), ("c", "a", "r", "c", 1.0, 1, ["x"])], edges)
    writers.write_table(one, root, "edges")
    writers.write_table(one.where("book_id = 'b'").withColumn("weight", F.lit(9.0)), root, "edges")
    assert {(r.book_id, r.weight) for r in readers.artifact(spark, root, "edges").collect()} == {("b", 9.0), ("c", 1.0)}
    writers.write_graph(one, root)
    assert spark.read.parquet(f"{root}/graph_entities").count() == 4
    p = spark.createDataFrame([("b", 1), ("c", 2)], "book_id string, x int")
    writers.write_predictions(p.where("book_id = 'b'"), root, "C1")
    writers.write_predictions(p.withColumn("x", F.lit(7)), root, "C1")
    assert {(r.book_id, r.x) for r in spark.read.parquet(f"{root}/predictions_C1").collect()} == {("b", 1), ("c", 7)}
    writers.write_tree(spark.createDataFrame([("b", "n", [3.0, 4.0])], "book_id string, node_id string, embedding array<float>"), root)
    assert spark.read.parquet(f"{root}/node_vectors").first().embedding_unit == pytest.approx([0.6, 0.8])
    results = spark.createDataFrame([("b", "c1", None), ("b", "c2", [])], "book_id string, chunk_id string, items array<string>")
    writers.append_results(results, root, "cache")
    assert [r.chunk_id for r in spark.read.parquet(f"{root}/cache").collect()] == ["c2"]
    with writers.timed(spark, root, "x"):
        pass
    assert spark.read.parquet(f"{root}/run_times").count() == 1


def test_seams(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i int, t string")
    sizes = seams.apply_texts(rows, "t", "o", lambda texts: [str(len(texts)) for _ in texts], batch=2)
    assert {r.o for r in sizes.collect()} <= {"1", "2"}
    broken = seams.apply_texts(rows, "t", "o", lambda texts: 1 / 0)
    assert {r.o for r in broken.collect()} == {None}
    names = seams.StandIns().recognised(spark.createDataFrame([(1, '"Anna" met bob, Carl.')], "i int, t string"), "t")
    assert [(r.label, r.name) for r in names.collect()] == [("PERSON", "Anna"), ("PERSON", "Carl")]


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "b", [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id int, book string, v array<double>")
    asked = rows.selectExpr("id AS qid", "book", "v AS qv")
    whole = sorted(map(tuple, search.top_k(asked, rows, 4, exclude_self=True).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    monkeypatch.setattr(search, "ROW_BLOCK", 11)
    assert sorted(map(tuple, search.top_k(asked, rows, 4, exclude_self=True).collect())) == whole
    assert sorted(map(tuple, search.top_k(asked, rows, 4, book="book", exclude_self=True).collect())) == whole


def test_streams(spark, tmp_path):
    schema = "book_id string, source string, relation string, target string, weight double, support_count int, chunk_ids array<string>, ingested_at timestamp"
    rows = spark.sql("SELECT 'b' book_id, 'a' source, 'r' relation, 'c' target, 2D weight, 1 support_count, array('chunk_1') chunk_ids, timestamp '2025-01-01 00:00:00' ingested_at")
    source = str(tmp_path / "in")
    rows.unionByName(rows).write.parquet(source)
    once = ingest.once(ingest.read_arrivals(spark, source, schema), ["book_id", "source"])
    q = once.writeStream.format("memory").queryName("once_rows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once_rows").count() == 1
    late = rows.withColumn("ingested_at", F.expr("timestamp '2025-03-01 00:00:00'"))
    older = rows.withColumn("chunk_ids", F.expr("array('chunk_1', 'chunk_2')")).withColumn("weight", F.lit(9.0))  # of more support, but older
    for batch in (rows, late.withColumn("weight", F.lit(5.0)).unionByName(older), older):
        batch.write.mode("append").parquet(source)
        ingest.merge_edge_stream(ingest.read_arrivals(spark, source, schema), str(tmp_path / "edges"), str(tmp_path / "check")).awaitTermination(120)
    assert [(r.target, r.weight) for r in spark.read.parquet(str(tmp_path / "edges")).collect()] == [("c", 5.0)]
