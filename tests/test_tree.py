import numpy as np
from pyspark.sql import functions as F

from folioweave import seams
from folioweave.operators import tree


def test_rollup_of_a_graph_with_two_parents(spark):
    edges = spark.createDataFrame([("b", "L1_a", "L0_1"), ("b", "L1_a", "L0_2"), ("b", "L1_b", "L0_2"), ("b", "L2_a", "L1_a"), ("b", "L2_a", "L1_b"), ("c", "L1_a", "L0_9")], "book_id string, parent_id string, child_id string")
    leaves = spark.createDataFrame([("b", "L0_1"), ("b", "L0_2"), ("c", "L0_9")], "book_id string, node_id string")
    found = {(r.book_id, r.node_id): r.c for r in tree.leaf_rollup(edges, leaves, 2).groupBy("book_id", "node_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("c")).collect()}
    assert found[("b", "L2_a")] == ["L0_1", "L0_2"] and found[("b", "L1_b")] == ["L0_2"] and found[("c", "L1_a")] == ["L0_9"] and found[("b", "L0_1")] == ["L0_1"]
    parents = {r.node_id: (r.n_parents, r.parents) for r in tree.parents_of(edges).where("book_id = 'b'").collect()}
    assert parents["L0_2"] == (2, "L1_a,L1_b")


def test_soft_assign(spark):
    rows = spark.createDataFrame([(1, [0.05, 0.95]), (2, [0.4, 0.6]), (3, [0.1, 0.1]), (4, [1.0]), (5, [])], "id int, p array<double>")
    found: dict[int, list[int]] = {}
    for r in tree.soft_assign(rows).orderBy("id", "cluster").collect():
        found.setdefault(r.id, []).append(r.cluster)
    assert found == {1: [1], 2: [0, 1], 3: [0], 4: [0]}


def test_stop_rule(spark):
    stats = spark.createDataFrame([("a", 0, 5), ("b", 0, 20), ("b", 1, 6), ("b", 2, 6), ("c", 0, 30)], "book_id string, level int, n_nodes bigint")
    found = {(r.book_id, r.level): r.grows for r in tree.stop_levels(stats).collect()}
    assert found == {("a", 0): False, ("b", 0): True, ("b", 1): False, ("b", 2): False, ("c", 0): False}


def test_choose_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in (0, 5, 10)])
    k, p, scores = tree.choose_clusters(x, 8)
    assert k == 3 and p.shape == (120, 3) and np.allclose(p.sum(axis=1), 1) and len(scores) <= 7
    assert tree.choose_clusters(x[:3], 8)[0] == 1


def test_two_stage_invariants(spark):
    rng = np.random.default_rng(1)
    rows = [("b", f"n{i}", [float(v) for v in rng.normal(i % 4, 0.05, 6)]) for i in range(120)] + [("s", "only", [1.0] * 6)]
    nodes = spark.createDataFrame(rows, "book_id string, node_id string, embedding array<float>")
    reduced = tree.reduce_dim(nodes, 3)
    assert {len(r.z) for r in reduced.collect()} == {3}
    found = tree.two_stage_clusters(reduced, sample=50)
    assert found.select("book_id", "node_id").distinct().count() == 121  # every node has at least one label
    again = {tuple(r) for r in tree.two_stage_clusters(reduced, sample=50).collect()}
    assert {tuple(r) for r in found.collect()} == again  # the same whatever order rows come in
    parents = tree.group_parents(found, 1)
    assert parents.count() == found.distinct().count() and parents.where("NOT parent_id LIKE 'L1_C%'").count() == 0


def test_build_tree(spark):
    texts = ["the sea and the ship", "a ship on the sea", "bread from the baker", "the baker sold bread", "sea ship sail", "flour bread oven"] * 3
    chunks = spark.createDataFrame([("b", f"L0_chunk_{i}", t) for i, t in enumerate(texts)] + [("s", f"L0_chunk_{i}", t) for i, t in enumerate(texts[:5])], "book_id string, chunk_id string, text string")
    models = seams.Models(lambda xs: [x[-30:] for x in xs], lambda xs: [[float(x.count(c)) for c in "abest"] for x in xs])
    nodes, edges = tree.build_tree(tree.leaf_nodes(chunks), models.summarise, models.embed)
    sizes = {(r.book_id, r.level): r.n for r in tree.level_stats(nodes).withColumnRenamed("n_nodes", "n").collect()}
    assert sizes["b", 0] == 18 and 0 < sizes["b", 1] < 18 and ("s", 1) not in sizes
    assert {r.child_id for r in edges.where("child_id LIKE 'L0%'").collect()} == {f"L0_chunk_{i}" for i in range(18)}
    assert nodes.where("level > 0 AND (text IS NULL OR embedding IS NULL)").count() == 0
    none, nothing = tree.build_tree(tree.leaf_nodes(chunks.where("false")), models.summarise, models.embed)
    assert none.count() == 0 and nothing.count() == 0


def test_summary_input(spark):
    edges = spark.createDataFrame([("b", "p", "x"), ("b", "p", "y"), ("b", "p", "z")], "book_id string, parent_id string, child_id string")
    nodes = spark.createDataFrame([("b", "x", "one"), ("b", "y", None), ("b", "z", "two")], "book_id string, node_id string, text string")
    assert tree.summary_input(edges, nodes).first().text == "one\n\n---\n\ntwo"
