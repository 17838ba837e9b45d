import random

from folioweave.config import Adaptive, Region
from folioweave.operators import adaptive, region
from folioweave.operators.questions import dense, question_entities

EDGES = "book_id string, source string, relation string, target string, weight double, chunk_ids array<string>"


def test_question_entities(spark):
    q = spark.createDataFrame([(1, "b", "Where did Anna Lee, the baker, meet Bo-Bo?"), (2, "b", ""), (3, "x", "Anna Lee?")], "qid int, book_id string, question string")
    m = spark.createDataFrame([("b", "c", e) for e in ("anna lee", "lee", "bo-bo", "other")], "book_id string, chunk_id string, entity string")
    assert sorted((r.qid, r.entity, r.pos) for r in question_entities(q, m).collect()) == [(1, "anna lee", 2), (1, "bo-bo", 7), (1, "lee", 3)]


def loop(distances, chunks_of, cap, top):
    """The step-by-step rule for one question: pairs with distances, their chunks, singles as the fallback at the top."""
    def count(k, fallback):
        found = set().union(*[chunks_of[p] for p, d in distances.items() if d <= k]) if any(d <= k for d in distances.values()) else set(fallback)
        return found

    k, now = top, count(top, chunks_of["single"])
    steps = [(k, len(now))]
    while len(now) > cap and k > 1:
        following = count(k - 1, ())
        if not following:
            break
        k, now = k - 1, following
        steps.append((k, len(now)))
    return k, len(now), ",".join(f"{a}:{b}" for a, b in steps)


def test_tighten_equals_the_loop(spark):
    rng = random.Random(9)
    rows, expected = [], {}
    for qid in range(120):
        pairs = {f"p{i}": rng.randint(1, 4) for i in range(rng.randint(0, 4))}
        chunks = {p: {f"c{rng.randint(0, 12)}" for _ in range(rng.randint(1, 6))} for p in pairs} | {"single": {f"c{rng.randint(0, 12)}" for _ in range(rng.randint(1, 9))}}
        for p, d in pairs.items():
            rows += [(qid, d, c, [p]) for c in chunks[p]]
        if not pairs:
            rows += [(qid, 4, c, ["s"]) for c in chunks["single"]]
        expected[qid] = loop(pairs, chunks, 4, 4)
    frame = spark.createDataFrame(rows, "qid int, d int, chunk_id string, names array<string>")
    found = {r.qid: (r.k, r.n_chunks, r.history) for r in adaptive.tighten(frame, Adaptive(max_chunks=4)).collect()}
    assert found == expected


def test_pair_chunks_skips_ends_without_chunks(spark):
    m = spark.createDataFrame([("b", "c1", "x"), ("b", "c2", "x"), ("b", "c2", "y"), ("b", "c3", "z_z")], "book_id string, chunk_id string, entity string")
    p = spark.createDataFrame([(1, "b", "x", "y", 1), (2, "b", "ghost", "x", 1), (3, "b", "x", "z_z", 2)], "qid int, book_id string, a string, b string, d int")
    assert sorted((r.qid, r.chunk_id) for r in adaptive.pair_chunks(p, m).collect()) == [(1, "c2"), (2, "c1"), (2, "c2")]


def test_merge_keys(spark):
    rows = spark.createDataFrame([(1, "c", ["x", "a_b"]), (1, "c", ["x", "k"]), (1, "d", ["x"])], "qid int, chunk_id string, names array<string>")
    assert {r.chunk_id: r.key for r in adaptive.merge_keys(rows).collect()} == {"c": ["a_b", "k", "x"], "d": ["x"]}


def world(spark):
    q = spark.createDataFrame([(1, "b", "Did anna meet bob?", None), (2, "b", "Nobody here?", []), (3, "b", "What of carl?", ["u", "v"])], "qid int, book_id string, question string, options array<string>")
    texts = spark.createDataFrame([("b", f"L0_chunk_{i}", i, t) for i, t in enumerate(["anna met bob", "bob slept", "carl ran", "", "nobody came here"])], "book_id string, chunk_id string, ord int, text string")
    m = spark.createDataFrame([("b", "L0_chunk_0", "anna"), ("b", "L0_chunk_0", "bob"), ("b", "L0_chunk_1", "bob"), ("b", "L0_chunk_2", "carl"), ("b", "L0_chunk_3", "carl")], "book_id string, chunk_id string, entity string")
    e = spark.createDataFrame([("b", "anna", "met", "bob", 1.0, ["L0_chunk_0"]), ("b", "bob", "knows", "carl", 1.0, ["L0_chunk_1", "L0_chunk_9"])], EDGES)
    nodes = texts.selectExpr("book_id", "chunk_id AS node_id", "text").unionByName(spark.createDataFrame([("b", "L1_C0", "anna bob nobody"), ("b", "L1_C1", "carl ran here")], "book_id string, node_id string, text string"))
    leaves = spark.createDataFrame([("b", f"L0_chunk_{i}", f"L0_chunk_{i}") for i in range(5)] + [("b", "L1_C0", f"L0_chunk_{i}") for i in (0, 1, 4)] + [("b", "L1_C1", f"L0_chunk_{i}") for i in (2, 3)], "book_id string, node_id string, chunk_id string")
    bridge = leaves.join(m, ["book_id", "chunk_id"]).select("book_id", "node_id", "entity").distinct()
    return q, texts, m, e, nodes, leaves, bridge


def test_routes_of_c1(spark):
    q, _, m, e, nodes, _, bridge = world(spark)
    found = adaptive.retrieve(q, question_entities(q, m), m, e, nodes, bridge, Adaptive(max_chunks=3, dense_pool=4))
    rows = {r.qid: r for r in adaptive.result(found).collect()}
    assert rows[1]["mode"] == "Local" and rows[1].chunk_ids == "L0_chunk_0" and rows[1].history == "4:1"
    assert rows[2]["mode"] == "Global" and rows[2].n_chunks == 3
    assert rows[3]["mode"] == "Occurrence Rerank"
    texts = {r.qid: r.context for r in adaptive.context(found, q, nodes).collect()}
    assert texts[1] == "anna_bob: anna met bob"


def test_routes_of_c2(spark):
    q, texts, m, e, nodes, leaves, bridge = world(spark)
    make = lambda **kw: region.Stages(q, question_entities(q, m), m, e, nodes, texts, leaves, bridge, Region(**kw))
    s = make(min_candidates=2)
    modes = {r.qid: r["mode"] for r in s.route.collect()}
    assert modes[1] == "graph_traversal"
    records = {(r.qid, r.source, r.target): r.evidence for r in s.records.collect()}
    assert records[(1, "anna", "bob")] == ["L0_chunk_0"] == records[(1, "bob", "anna")]  # an edge between two seeds is met twice
    assert "L0_chunk_3" not in {r.node_id for r in s.ranked.collect()}  # it has no text
    assert {r.qid for r in region.result(s).where("chunk_ids <> ''").collect()} == {1, 2, 3}
    assert {r["mode"] for r in make(min_candidates=50).route.collect()} == {"fallback_no_candidates"}
    literal = make(strict_reference_ids=True)  # ids without prefix meet nothing, as in the reference
    assert {r["mode"] for r in literal.route.collect()} <= {"fallback_no_seeds", "fallback_no_candidates"}


def test_entity_cap(spark):
    chunks = spark.createDataFrame([("b", f"L0_chunk_{i}", i, "t") for i in range(12)], "book_id string, chunk_id string, ord int, text string")
    m = chunks.selectExpr("book_id", "chunk_id", "'x' AS entity")
    closed = spark.createDataFrame([(1, "b", "x")], "qid int, book_id string, entity string")
    in_region = chunks.selectExpr("1 AS qid", "book_id", "chunk_id")
    none = spark.createDataFrame([], "qid int, book_id string, evidence array<string>")
    found = region.candidates(none, closed, m, in_region, chunks, 10)
    assert sorted(int(r.node_id.split("_")[-1]) for r in found.collect()) == list(range(10))


def test_dense_stays_in_its_book(spark):
    q = spark.createDataFrame([(1, "b", "abc", None), (2, "none", "abc", None)], "qid int, book_id string, question string, options array<string>")
    nodes = spark.createDataFrame([("b", "n1", "abc"), ("b", "n2", "zzz"), ("b", "n3", None), ("c", "n4", "abc")], "book_id string, node_id string, text string")
    assert [(r.node_id, r.cos) for r in dense(q, nodes, 5).orderBy("place").collect()] == [("n1", 1.0), ("n2", 0.0)]
