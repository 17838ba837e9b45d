import random

from folioweave.operators import graph

EDGES = "book_id string, source string, relation string, target string, weight double, chunk_ids array<string>"


def test_normalise(spark):
    rows = spark.createDataFrame([("b", " a ", "r", "c", None, ["chunk_1", "L0_chunk_1", None]), ("b", "a", "r", "d", 0.0, None), ("b", "a", " ", "c", 2.0, []), ("b", "a", "r", None, 2.0, [])], EDGES)
    found = {r.target: (r.source, r.weight, r.support_count) for r in graph.normalise(rows).collect()}
    assert found == {"c": ("a", 1.0, 1), "d": ("a", 1.0, 0)}
    scalar = spark.createDataFrame([("b", "a", "r", "c", 2.0, "chunk_1")], EDGES.replace("array<string>", "string"))
    assert graph.normalise(scalar).first().chunk_ids == ["L0_chunk_1"]


def test_upsert_keeps_the_last(spark):
    rows = spark.createDataFrame([("b", "a", "r", "c", 1.0, ["x"], 1, 1), ("b", "a", "r", "c", 5.0, ["y"], 1, 2), ("b2", "a", "r", "c", 7.0, ["z"], 1, None)], EDGES + ", support_count int, at int")
    assert {(r.book_id, r.weight) for r in graph.upsert(rows, "at").collect()} == {("b", 5.0), ("b2", 7.0)}


def test_entities_and_mentions(spark):
    rows = spark.createDataFrame([("b", "a", "r", "c", 1.0, ["x", "y"]), ("b", "c", "r", "a", 1.0, [])], EDGES)
    assert graph.entities(rows).count() == 2 and graph.mentioned_in(rows).count() == 4
    assert graph.repeated_keys(rows, "book_id").first().times == 2


def brute(edges, start):
    seen, frontier, d = {start: 0}, {start}, 0
    while frontier:
        d += 1
        frontier = {y for a, b in edges for x, y in ((a, b), (b, a)) if x in frontier} - seen.keys()
        seen |= dict.fromkeys(frontier, d)
    return seen


def test_distances_equal_a_plain_search(spark):
    rng = random.Random(5)
    edges = {b: [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(22)] for b in ("b1", "b2")}
    frame = spark.createDataFrame([(b, x, "r", y, 1.0, []) for b, es in edges.items() for x, y in es], EDGES)
    starts = spark.createDataFrame([(b, f"n{i}") for b in edges for i in (0, 7, 99)], "book_id string, start string")
    for hops in (1, 3):
        found = {(r.book_id, r.start, r.node): r.d for r in graph.distances(starts, frame, hops).collect()}
        assert found == {(b, s, n): d for b in edges for s in ("n0", "n7", "n99") for n, d in brute(edges[b], s).items() if d <= hops}


def test_pairs_and_paths(spark):
    frame = spark.createDataFrame([("b", "a", "r", "m", 1.0, []), ("b", "z", "r", "m", 1.0, []), ("b", "a", "r", "k", 1.0, []), ("b", "k", "r", "z", 1.0, []), ("b", "z", "r", "w", 1.0, []), ("c", "a", "r", "w", 1.0, [])], EDGES)
    pairs = spark.createDataFrame([("b", "a", "z"), ("b", "a", "w"), ("b", "a", "nowhere")], "book_id string, a string, b string")
    assert {r.b: r.d for r in graph.pair_distances(pairs, frame, 2).collect()} == {"z": 2, "w": None, "nowhere": None}
    assert {r.b: (r.d, r.path) for r in graph.shortest_paths(pairs, frame, 3).collect()} == {"z": (2, "a > k > z"), "w": (3, "a > k > z > w")}


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    starts = spark.createDataFrame([("b", "a")], "book_id string, start string")
    assert [tuple(r) for r in graph.distances(starts, none).collect()] == [("b", "a", "a", 0)]
