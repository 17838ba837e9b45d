import json

from pyspark.sql import functions as F

from folioweave.operators import postings, relations
from folioweave.operators.ranking import placed
from folioweave.prompts import RELATION

KEY = "book_id string, chunk_id string, "


def test_mentions_from_a_recogniser(spark):
    rows = spark.createDataFrame([("b", "c1", "PERSON", " Anna  Lee "), ("b", "c1", "PERSON", "anna lee"), ("b", "c1", "DATE", "Monday"), ("b", "c1", "ORG", "It"), ("b", "c2", "GPE", None)], KEY + "label string, name string")
    assert [tuple(r) for r in postings.extract_mentions(rows).collect()] == [("b", "c1", "anna lee")]


def test_posting_lists_keep_empty_chunks(spark):
    chunks = spark.createDataFrame([("b", "c1", 2), ("b", "c2", 1), ("b", "c3", 0)], KEY + "ord int")
    mentions = spark.createDataFrame([("b", "c1", "x"), ("b", "c2", "x"), ("b", "c1", "a")], KEY + "entity string")
    assert {r.chunk_id: r.entities for r in postings.chunk_entities(chunks, mentions).collect()} == {"c1": ["a", "x"], "c2": ["x"], "c3": []}
    assert {r.entity: r.chunk_ids for r in postings.entity_chunks(mentions, chunks).collect()} == {"x": ["c2", "c1"], "a": ["c1"]}
    leaves = spark.createDataFrame([("b", "n", "c1"), ("b", "n", "c2"), ("b", "m", "c3")], "book_id string, node_id string, chunk_id string")
    bridge = postings.node_entities(leaves, mentions)
    nodes = leaves.select("book_id", "node_id").distinct()
    assert {r.node_id: r.entities for r in postings.node_entity_lists(nodes, bridge).collect()} == {"n": ["a", "x"], "m": []}
    assert {r.entity: r.node_ids for r in postings.entity_nodes(bridge).collect()} == {"a": ["n"], "x": ["n"]}


def test_parse_output(spark):
    item = {"source": "a", "relation": "r", "target": "b"}
    cases = {
        "empty": ("", False, []),
        "plain": (json.dumps([item]), False, [("a", "r", "b")]),
        "fenced": ("```json\n" + json.dumps([item]) + "\n```", False, [("a", "r", "b")]),
        "prose": ("Here: " + json.dumps([item]) + " done", False, [("a", "r", "b")]),
        "junk element": (json.dumps(["x", item, 3]), False, [(None, None, None), ("a", "r", "b"), (None, None, None)]),
        "object": (json.dumps(item), True, None),
        "cut": (json.dumps([item])[:-4], True, None),
        "two lists": ("[1] and [2]", True, None),
        "missing field": (json.dumps([{"source": "a"}]), False, [("a", None, None)]),
        "null": (None, True, None),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, raw string")
    found = {r.name: (r.failed, None if r["items"] is None else [tuple(x) for x in r["items"]]) for r in relations.parse_output(rows).collect()}
    assert found == {k: v[1:] for k, v in cases.items()}


def test_validate_dedup_merge(spark):
    mentions = spark.createDataFrame([("b", c, e) for c in ("c1", "c2", "c3") for e in ("mr. x", "y", "z")], KEY + "entity string")
    raw = spark.createDataFrame(
        [("b", c, "X", "Knows ", "y") for c in ("c1", "c2", "c3")] + [("b", "c1", "Mr. X", "knows", "Y"), ("b", "c1", "x", "is", "Mr X"), ("b", "c1", "x", "r", "stranger"), ("b", "c1", "x", "", "y"), ("b", "c1", None, "r", "y"), ("b", "c9", "x", "r", "y")],
        KEY + "source string, relation string, target string",
    )
    valid = relations.validate(raw, mentions)
    assert valid.count() == 4
    edges = relations.merge_edges(relations.dedup(valid)).collect()
    assert [(r.source, r.relation, r.target, r.weight, r.chunk_ids) for r in edges] == [("x", "knows", "y", 3.0, ["c1", "c2", "c3"])]


def test_pending_and_prompts(spark):
    mentions = spark.createDataFrame([("b", "c1", "x"), ("b", "c1", "y"), ("b", "c2", "x"), ("b", "c3", "y"), ("b", "c3", "z")], KEY + "entity string")
    eligible = relations.eligible_chunks(mentions)
    assert {r.chunk_id for r in eligible.collect()} == {"c1", "c3"}
    cached = spark.createDataFrame([("b", "c1"), ("b", "c1")], "book_id string, chunk_id string")
    assert [r.chunk_id for r in relations.pending(eligible, cached).collect()] == ["c3"]
    chunks = spark.createDataFrame([("b", "c1", "t" * 9000), ("b", "c3", None)], KEY + "text string")
    assert {r.chunk_id: len(r.prompt) for r in relations.prompts(eligible, chunks, mentions).collect()} == {"c1": len(RELATION.format_map({"entities": "x, y", "text": ""})) + 8000, "c3": len(RELATION.format_map({"entities": "y, z", "text": ""}))}


def test_by_weight(spark):
    edges = spark.createDataFrame([("b", s, "r", "t", w) for s, w in (("a", 1.0), ("c", 2.0), ("b", 2.0))] + [("x", "a", "r", "t", 1.0)], "book_id string, source string, relation string, target string, weight double")
    assert sorted((r.book_id, r.place, r.source) for r in relations.by_weight(edges).collect()) == [("b", 1, "b"), ("b", 2, "c"), ("b", 3, "a"), ("x", 1, "a")]


def test_places_over_many_ranges(spark):
    rows = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.xxhash64("id").alias("v"))
    found: dict[str, list] = {}
    for r in placed(rows, ["k"], [F.desc("v")]).collect():
        found.setdefault(r.k, []).append((r.place, r.v))
    assert sum(map(len, found.values())) == 3000
    for items in found.values():
        assert [v for _, v in sorted(items)] == sorted((v for _, v in items), reverse=True) and [p for p, _ in sorted(items)] == list(range(1, len(items) + 1))
    assert placed(rows.where("false"), [], [F.col("v")]).count() == 0
    assert sorted(r.place for r in placed(rows.limit(40), [], [F.col("v")]).collect()) == list(range(1, 41))


def test_adjacent_relations(spark):
    mentions = spark.createDataFrame([("b", "c1", e) for e in "cab"] + [("b", "c2", "a")], KEY + "entity string")
    assert sorted((r.source, r.target) for r in relations.adjacent_relations(mentions).collect()) == [("a", "b"), ("b", "c")]
    assert relations.adjacent_relations(mentions.where(F.lit(False))).count() == 0
