import numpy as np
import pyarrow as pa
import pytest

import folioweave.llm.clusters as module
from folioweave.llm.clusters import cliques, grid_shape, packed, shared_cell, similar_groups, typical_members, unpacked
from folioweave.llm.components import minimum_labels
from tests.llm.test_vectors import frame, planted


def labelled(found):
    return {r.key: (r.label, r.n) for r in found.collect()}


def brute(ids, rows, bar=0.65, smallest=4):
    """Groups of all connected sets by comparing all pairs."""
    units = rows.astype(np.float64) / np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    cosines = units @ units.T
    met = cosines >= bar - 1e-9
    for _ in range(8):
        met = met @ met
    reached, right = met.argmax(axis=1), {}
    for low in np.unique(reached):
        at = np.flatnonzero(reached == low)
        inner = cosines[np.ix_(at, at)].copy()
        if len(at) >= smallest and (inner >= bar - 1e-9).all():
            labels = np.full(len(at), ids[at].min())
        else:
            labels = cliques(ids[at], inner, bar, smallest)
        for k in np.flatnonzero(labels >= 0):
            right[int(ids[at[k]])] = (int(labels[k]), int((labels == labels[k]).sum()))
    return right


def chained(seed=11, size=24):
    """Groups whose neighbours along a chain are similar too, tied by cosines between 0.65 and 0.75."""
    rng = np.random.default_rng(seed)
    turn = np.deg2rad(47)
    at = lambda k: np.r_[np.cos(turn * k), np.sin(turn * k), np.zeros(size - 2)]
    rows = np.concatenate([at(k) + 0.03 * rng.standard_normal((6, size)) for k in range(3)]).astype(np.float32)
    return np.arange(len(rows)) * 2 + 5, rows


def test_large_sets_are_divided_like_small_ones(spark, monkeypatch):
    ids, rows = chained()
    right = labelled(similar_groups(frame(spark, ids, rows), "id", "v", 24))
    assert right and right == brute(ids, rows)
    monkeypatch.setattr(module, "LARGE", 3)
    monkeypatch.setattr(module, "TILE", 12)
    assert labelled(similar_groups(frame(spark, ids, rows), "id", "v", 24)) == right


def test_a_large_group_beside_others_is_kept(spark, monkeypatch):
    """200 records that are nearly equal, with a tail of linked ones: nothing of it may vanish in tables."""
    size, turn = 24, np.deg2rad(40)
    rng = np.random.default_rng(2)
    arc = [np.r_[np.cos(turn * k), np.sin(turn * k), np.zeros(size - 2)] for k in range(1, 4)]
    rows = np.concatenate([np.eye(size)[0] + 0.01 * rng.standard_normal((60, size)), np.array(arc)]).astype(np.float32)
    ids = np.arange(len(rows))
    right = brute(ids, rows)
    assert len(right) >= 60
    monkeypatch.setattr(module, "LARGE", 7)
    monkeypatch.setattr(module, "TILE", 16)
    assert labelled(similar_groups(frame(spark, ids, rows), "id", "v", size)) == right


def test_a_group_that_another_row_could_join_does_not_count(spark, monkeypatch):
    """Row 16 is similar to all of both sets. Beside its own group of ten the other seven are no group: it could join them."""
    a, b = np.eye(24)[:2]
    rng = np.random.default_rng(3)
    near = lambda c, n: c + 0.001 * rng.standard_normal((n, 24))
    rows = np.concatenate([near(a, 9), near(b, 7), (a + b)[None]]).astype(np.float32)
    for large in (4096, 6):
        monkeypatch.setattr(module, "LARGE", large)
        found = labelled(similar_groups(frame(spark, np.arange(17), rows), "id", "v", 24))
        assert found == {k: (0, 10) for k in [*range(9), 16]}


def test_larger_sets_are_judged_like_small_ones(spark, monkeypatch):
    """Wide groups, with members beyond half the angle from their mean, in tiles; one pair of the second is below the bar."""
    ids, rows = planted(6, [60, 7], 50, spread=0.62)
    right = brute(ids, rows)
    assert labelled(similar_groups(frame(spark, ids, rows), "id", "v", 24)) == right
    monkeypatch.setattr(module, "TILE", 8)
    assert labelled(similar_groups(frame(spark, ids, rows), "id", "v", 24)) == right


def test_cells_are_turned_until_members_at_the_bar_meet():
    for total in (1_000, 80_000, 10_000_000, 1_000_000_000):
        axes, turns = grid_shape(total, 96)
        assert 1 - (1 - shared_cell(axes, 96, 0.65)) ** (3 * turns) >= module.MEET
    assert grid_shape(1_000, 96) == grid_shape(80_000, 96) and grid_shape(1_000_000_000, 96)[0] > 2


@pytest.mark.parametrize("axes", [1, 2, 3, 4])
def test_groups_near_the_bar_are_found_on_any_grid(spark, monkeypatch, axes):
    rng = np.random.default_rng(axes)
    size, rows = 96, []
    for _ in range(60):  # groups of four of which all pairs are at 0.68
        own = np.linalg.qr(rng.standard_normal((size, 5)))[0].T
        rows += list(np.sqrt(0.68) * own[0] + np.sqrt(0.32) * own[1:])
    rows = np.concatenate([np.array(rows), rng.standard_normal((200, size))]).astype(np.float32)
    ids = rng.permutation(len(rows))
    turns = max(1, int(np.ceil(np.log(1 - module.MEET) / (3 * np.log1p(-shared_cell(axes, size, 0.65))))))
    monkeypatch.setattr(module, "grid_shape", lambda *_: (axes, turns))
    found, right = labelled(similar_groups(frame(spark, ids, rows), "id", "v", size)), brute(ids, rows)
    assert len(right) == 240 and set(found.items()) <= set(right.items()) and len(found) >= 0.97 * len(right)


def test_groups_in_crowded_cells(spark, monkeypatch):
    """Records that all lean to one axis, so that every cell holds several tiles: as if it held one."""
    ids, rows = planted(8, [4] * 12, 0, spread=0.5)
    rows[:] /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[:, 0] += 0.8
    whole = labelled(similar_groups(frame(spark, ids, rows), "id", "v", 24, 0.8))
    right = brute(ids, rows, 0.8)
    assert set(whole.items()) <= set(right.items()) and len(whole) > 0.8 * len(right) > 0
    monkeypatch.setattr(module, "TILE", 8)
    assert labelled(similar_groups(frame(spark, ids, rows), "id", "v", 24, 0.8)) == whole


def test_rows_of_a_crowded_cell_all_meet(spark, monkeypatch):
    monkeypatch.setattr(module, "TILE", 4)
    rows = np.eye(24)[0] + 0.05 * np.random.default_rng(2).standard_normal((30, 24))
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    entries = spark.createDataFrame([(i, bytearray(p), 7) for i, p in enumerate(packed(units))] + [(99, bytearray(packed(-units[:1])[0]), 7)], "key bigint, packed binary, cell bigint")
    assert {(r.id, r.label) for r in minimum_labels(module.dense_links(entries, 0.65)).collect()} == {(i, 0) for i in range(30)}


def test_packed_vectors_stay_near():
    rng = np.random.default_rng(4)
    for size in (23, 96):
        units = rng.standard_normal((400, size))
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        back = unpacked(pa.array(packed(units), pa.binary()))[:, :size]
        assert np.abs(back @ back.T - units @ units.T)[~np.eye(400, dtype=bool)].max() < 1.5 * module.slack(size)


def test_typical_members_stand_in_the_densest_cell(spark):
    rng = np.random.default_rng(9)
    tight = np.eye(24)[0] + 0.001 * rng.standard_normal((5, 24))
    loose = np.eye(24)[0] + 0.13 * rng.standard_normal((4, 24))
    ids, rows = np.arange(9), np.concatenate([tight, loose]).astype(np.float32)
    groups = spark.createDataFrame([(int(i), 0, 9) for i in ids], "key bigint, label bigint, n bigint")
    found = typical_members(groups, frame(spark, ids, rows), "id", "v", 24).collect()
    assert [(r.label, r.n) for r in found] == [(0, 9)] and set(found[0].typical) <= set(range(5))
