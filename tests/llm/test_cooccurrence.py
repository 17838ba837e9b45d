import random
from collections import Counter
from itertools import combinations

from folioweave.llm.cooccurrence import associations, exceeding

SCHEMA = "book string, basket string, items array<string>, shared int, grp string"


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"b{rng.randint(0, 1)}", f"c{rng.randint(0, 40)}", [rng.choice(["a", "b", "c", "d", "é", "Z", None]) for _ in range(rng.randint(0, 5))], 1, "x") for _ in range(150)]
    rows += [("b0", "c1", None, 1, "x"), ("b0", "c2", [], 1, "x"), ("b0", None, ["a", "b"], 1, "x"), (None, "c1", ["a", "b"], 1, "x"), ("b0", "big", [f"i{k}" for k in range(200)], 1, "x")]
    baskets: dict[tuple, set] = {}
    for book, basket, items, *_ in rows:
        if book is not None and basket is not None:
            baskets.setdefault((book, basket), set()).update(x for x in items or [] if x is not None)
    n = Counter(book for book, _ in baskets)
    single = Counter((book, x) for (book, _), items in baskets.items() for x in items)
    pairs = Counter((book, *p) for (book, _), items in baskets.items() for p in combinations(sorted(items, key=lambda s: s.encode()), 2))
    expected = {k: (c, single[k[0], k[1]], single[k[0], k[2]], n[k[0]]) for k, c in pairs.items() if c >= 3}
    found = associations(spark.createDataFrame(rows, SCHEMA), "book", "basket", "items", 3)
    assert {(r.grp, r.item_a, r.item_b): (r.shared, r.n_a, r.n_b, r.n) for r in found.collect()} == expected
    assert exceeding(found).count() == sum(s * m >= 2 * a * b for s, a, b, m in expected.values())


def test_measures(spark):
    rows = [("b", f"c{i}", ["x", "y"] if i < 3 else ["x"] if i < 4 else [], 1, "x") for i in range(8)]
    r = associations(spark.createDataFrame(rows, SCHEMA), "book", "basket", "items", 3).first()
    assert (r.shared, r.n_a, r.n_b, r.n) == (3, 4, 3, 8) and r.lift == 2.0 and abs(r.conviction - (1 - 3 / 8) / (1 - 3 / 4)) < 1e-12


def test_empty(spark):
    assert associations(spark.createDataFrame([], SCHEMA), "book", "basket", "items", 3).count() == 0
