import random

import pytest

from folioweave.operators import chunking


def windows(spark, n, size, overlap):
    text = " ".join(f"w{i}" for i in range(n))
    rows = chunking.token_windows(spark.createDataFrame([("a", text)], "id string, t string"), "id", "t", size, overlap).orderBy("ord").collect()
    return [r.text.split(" ") for r in rows]


@pytest.mark.parametrize("n, size, overlap, count", [(0, 5, 2, 0), (3, 5, 2, 1), (5, 5, 2, 1), (6, 5, 2, 2), (8, 5, 2, 2), (9, 5, 2, 3)])
def test_windows(spark, n, size, overlap, count):
    found = windows(spark, n, size, overlap)
    assert len(found) == count
    for i, part in enumerate(found):
        assert part == [f"w{j}" for j in range(i * (size - overlap), min(n, i * (size - overlap) + size))]
    if found:
        assert found[-1][-1] == f"w{n - 1}"


def test_windows_reject_overlap(spark):
    with pytest.raises(ValueError):
        windows(spark, 3, 4, 4)


def test_windows_of_null_and_blank(spark):
    rows = spark.createDataFrame([("a", None), ("b", "  \n ")], "id string, t string")
    assert chunking.token_windows(rows, "id", "t", 5, 1).count() == 0


def scan(n, breaks, least, most):
    if n <= least:
        return [0] if n else []
    starts, start = [], 0
    for i in range(n):
        size = i + 1 - start
        if (i in breaks and size >= least) or size >= most or i == n - 1:
            starts.append(start)
            start = i + 1
    return starts


def test_semantic_equals_a_plain_scan(spark):
    rng = random.Random(3)
    cases = {f"d{c}": (rng.randint(1, 60), set()) for c in range(60)} | {"edge1": (3, {0, 1}), "edge2": (4, {2}), "edge3": (41, set())}
    for name, (n, breaks) in cases.items():
        breaks |= {i for i in range(n) if rng.random() < 0.2} if name.startswith("d") else set()
    sentences = spark.createDataFrame([(k, i, f"s{i}") for k, (n, _) in cases.items() for i in range(n)], "id string, pos int, sentence string")
    marks = spark.createDataFrame([(k, i) for k, (_, b) in cases.items() for i in b], "id string, pos int")
    found: dict[str, list[int]] = {}
    for r in chunking.semantic_chunks(sentences, marks, 3, 20).orderBy("id", "ord").collect():
        found.setdefault(r.id, []).append(r.first_pos)
        assert r.text.split(" ") == [f"s{i}" for i in range(r.first_pos, r.first_pos + r.n_sentences)]
    assert found == {k: scan(n, b, 3, 20) for k, (n, b) in cases.items()}


def test_equal_similarities_do_not_break(spark):
    sims = spark.createDataFrame([("a", i, 0.5) for i in range(6)], "id string, pos int, sim double")
    assert chunking.iqr_breakpoints(sims).count() == 0
    sims = spark.createDataFrame([("a", i, 0.9) for i in range(9)] + [("a", 9, 0.1)], "id string, pos int, sim double")
    assert [r.pos for r in chunking.iqr_breakpoints(sims).collect()] == [9]


def test_zero_vectors_are_at_cosine_zero(spark):
    rows = spark.createDataFrame([("a", 0, "123"), ("a", 1, "abc"), ("a", 2, "abc")], "id string, pos int, sentence string")
    assert [r.sim for r in chunking.adjacent_cosines(rows).orderBy("pos").collect()] == [0.0, 1.0]


def test_methods(spark):
    rows = spark.createDataFrame([("a", "One. Two. Three. Four. Five.")], "id string, t string")
    assert chunking.chunk("semantic_iqr", rows, "id", "t").count() == 1
    assert chunking.chunk("tokens", rows, "id", "t", window=2, overlap=0).count() == 3
    with pytest.raises(ValueError):
        chunking.chunk("other", rows, "id", "t")
