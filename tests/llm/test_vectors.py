import random

import numpy as np
import pytest

from folioweave.llm.clusters import cliques, group_pairs, similar_groups, typical_members
from folioweave.llm.components import minimum_labels
from folioweave.llm.neighbours import nearest

SCHEMA = "id bigint, v array<float>, key string, near string, label string"


def planted(seed, groups, singles, size=24, spread=0.35):
    """Groups of similar unit vectors and single ones, with ids in a random order."""
    rng = np.random.default_rng(seed)
    rows = []
    for n in groups:
        centre = rng.standard_normal(size)
        centre /= np.linalg.norm(centre)
        for _ in range(n):
            noise = rng.standard_normal(size)
            rows.append(centre + spread * noise / np.linalg.norm(noise))
    rows += list(rng.standard_normal((singles, size)))
    rows = np.array(rows, np.float32) * rng.uniform(0.2, 5, (len(rows), 1)).astype(np.float32)
    ids = rng.permutation(len(rows)) * 3 + 1
    return ids, rows


def frame(spark, ids, rows, extra=()):
    data = [(int(i), [float(x) for x in v], "k", "n", "l") for i, v in zip(ids, rows)] + [(i, v, "k", "n", "l") for i, v in extra]
    return spark.createDataFrame(data, SCHEMA)


BAD = [(900001, None), (900002, []), (900003, [0.0] * 24), (900004, [float("nan")] * 24), (900005, [1.0] * 23), (None, [1.0] * 24), (900006, [float("inf")] + [1.0] * 23), (900007, [None] + [1.0] * 23)]


def brute(ids, rows, k):
    units = rows.astype(np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    out = {}
    for i, key in enumerate(ids):
        cos = np.round(units @ units[i], 6)
        order = [j for j in np.lexsort((ids, -cos)) if j != i][:k]
        out[int(key)] = [int(ids[j]) for j in order]
    return out


def test_nearest_recall_and_order(spark):
    ids, rows = planted(1, [30, 12, 5, 4], 700)
    found = {r.key: list(r.near) for r in nearest(frame(spark, ids, rows, BAD), "id", "v", 24, 6, recall=0.98).collect()}
    true = brute(ids, rows, 6)
    assert found.keys() == true.keys()
    hits = sum(len(set(found[i]) & set(true[i])) for i in true)
    assert hits / (6 * len(true)) >= 0.95
    whole = {r.key: list(r.near) for r in nearest(frame(spark, ids, rows), "id", "v", 24, 6, recall=1.0).collect()}
    assert sum(whole[i] == true[i] for i in true) / len(true) >= 0.98


def test_nearest_with_copies_and_ties(spark):
    ids, rows = planted(2, [6], 20)
    ids, rows = np.concatenate([ids, 1000 + np.arange(15), 5000 + np.arange(3)]), np.concatenate([rows, np.repeat(rows[:1], 15, axis=0), np.repeat(rows[9:10], 3, axis=0)])
    data = frame(spark, ids, rows)
    found = {r.key: list(r.near) for r in nearest(data.unionByName(data.limit(5)), "id", "v", 24, 4, recall=1.0).collect()}
    assert found == brute(ids, rows, 4)


def test_nearest_of_few_and_none(spark):
    ids, rows = planted(3, [], 3)
    assert {r.key: len(r.near) for r in nearest(frame(spark, ids, rows), "id", "v", 24, 10).collect()} == {int(i): 2 for i in ids}
    assert [(r.key, list(r.near)) for r in nearest(frame(spark, ids[:1], rows[:1]), "id", "v", 24, 10).collect()] == [(int(ids[0]), [])]
    assert nearest(frame(spark, [], [], BAD), "id", "v", 24, 10).count() == 0


def test_groups(spark):
    ids, rows = planted(4, [40, 9, 5, 4, 3, 2], 300)
    data = frame(spark, ids, rows, BAD)
    found = similar_groups(data.unionByName(data.limit(30)), "id", "v", 24, 0.65, 4)
    sizes = sorted(r.n for r in found.select("label", "n").distinct().collect())
    assert sizes == [4, 5, 9, 40] and found.count() == 58
    assert group_pairs(found).count() == sum(n * (n - 1) // 2 for n in sizes)
    units = {int(i): v / np.linalg.norm(v) for i, v in zip(ids, rows.astype(np.float64))}
    for r in group_pairs(found).collect():
        assert r.a < r.b and units[r.a] @ units[r.b] >= 0.65
    typical = typical_members(found, data, "id", "v", 24, 2).collect()
    assert len(typical) == 4 and all(len(r.typical) == 2 for r in typical)


def test_groups_of_copies_and_none(spark):
    ids, rows = planted(5, [], 40)
    ids, rows = np.concatenate([ids, 700 + np.arange(4)]), np.concatenate([rows, np.repeat(rows[:1], 4, axis=0)])
    found = similar_groups(frame(spark, ids, rows), "id", "v", 24)
    assert {r.key for r in found.collect()} == {int(ids[0]), 700, 701, 702, 703}
    assert similar_groups(frame(spark, [], []), "id", "v", 24).count() == 0


def test_groups_in_tiles(spark, monkeypatch):
    import folioweave.llm.clusters as module

    monkeypatch.setattr(module, "TILE", 8)
    ids, rows = planted(6, [60, 7], 50)
    assert sorted(r.n for r in similar_groups(frame(spark, ids, rows), "id", "v", 24).select("label", "n").distinct().collect()) == [7, 60]


def test_cliques_of_a_chain():
    cosines = np.zeros((9, 9))
    for group in ((0, 1, 2, 3), (4, 5, 6, 7)):
        for a in group:
            for b in group:
                cosines[a, b] = 0.9
    cosines[3, 4] = cosines[4, 3] = cosines[8, 0] = cosines[0, 8] = 0.7
    assert list(cliques(np.arange(9), cosines, 0.65, 4)) == [0, 0, 0, 0, 4, 4, 4, 4, -1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 180)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.id: r.label for r in minimum_labels(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {x: find(x) for x in list(parent)}
    assert minimum_labels(spark.createDataFrame([], "a int, b int")).count() == 0


def test_blocks_scanned_together_are_read_once(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from folioweave.llm import neighbours

    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((240, 8)).astype(np.float32)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    index = neighbours._Index(np.eye(8), units[:6].astype(np.float64))
    index.first, index.bound, index.path = np.arange(6), 50.0, f"file://{tmp_path}"
    lists = np.arange(240) % 6
    for b in range(5):  # the sixth block has no rows
        at = np.flatnonzero(lists == b)
        (tmp_path / f"block={b}").mkdir()
        pq.write_table(pa.table({"key": pa.array(at), "v": pa.array([v.tobytes() for v in vectors[at]], pa.binary()), "list": pa.array(lists[at].astype(np.int32))}), tmp_path / f"block={b}" / "p.parquet")
    read, block = [], neighbours._Block
    monkeypatch.setattr(neighbours, "KEPT", 1)
    monkeypatch.setattr(neighbours, "_Block", lambda index, number: read.append(number) or block(index, number))
    found = {r.rep: list(r.near) for part in neighbours._scan(index, [1, 2, 3, 5], 4) for r in part.itertuples()}
    assert max(read.count(b) for b in (0, 4)) == 1 and len(read) <= 10
    stored = np.flatnonzero(lists < 5)
    for rep in np.flatnonzero((lists >= 1) & (lists <= 3)):
        cosines = {int(x): round(float(units[rep] @ units[x]), 6) for x in stored if x != rep}
        wanted = sorted(cosines, key=lambda x: (-cosines[x], x))[:4]
        assert [cosines[x] for x in found.pop(rep)] == pytest.approx([cosines[x] for x in wanted], abs=2e-6)
    assert not found


def test_groups_of_blocks_fit_memory_and_cores():
    from folioweave.llm import neighbours

    index = neighbours._Index(np.eye(4), np.eye(4)[np.zeros(4096, int)])
    index.first = np.zeros(4096, np.int64)
    for blocks, cores, most in ((50, 6, 1), (5700, 6, 16), (10**6, 6, 16)):
        index.first[-1] = blocks - 1
        together = neighbours._together(index, cores)
        assert 1 <= together <= most and together * neighbours.BLOCK * 4096 <= neighbours.REACHES and (together > 1) == (blocks > 50)
