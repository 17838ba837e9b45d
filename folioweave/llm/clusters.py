"""Clusters of mutually similar records, by grid density clustering.

Unit vectors are turned by several fixed rotations and their features quantised: the grid of one turn has a cell for each
set of signed axes, and a record stands in the cell of the axes on which it is largest and in the adjacent cells it is
nearest to. Cells are counted; records of a dense cell are linked if they are similar, so adjacent dense cells are joined by
the records they share. Minimum labels are propagated over the links to convergence, and an exact check keeps connected
sets of which all are similar and divides the others. A group is described by the members of its densest cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.components import minimum_labels
from folioweave.llm.vectors import collapsed_copies, rotation, unit, unpack, usable_rows
from folioweave.session import cut

#: Rows that one comparison holds at most on each side. A cell or set with more is compared in all pairs of tiles.
TILE = 1024
#: Members of a connected set, or candidates of one group, up to which one task divides it; beyond, tables do the same.
LARGE = 4096
#: Cells of one turn that a record stands in: its own and the adjacent ones nearest to it.
PROBES = 8
#: The chance that a member of a group of four, all of them just at the bar, meets at least one of the three others.
MEET = 0.99
#: Entries (cells of a record) that one round holds at once.
ENTRIES = 48
#: Comparisons of exact cosines allow for their last digits.
TINY = 1e-9


# the grid


@lru_cache(maxsize=16)
def _subsets(axes: int, size: int) -> tuple[np.ndarray, int]:
    """The sets of `axes` of the largest features that a record may stand in, and how many features they come from."""
    top = min(size, axes)
    while comb(top, axes) < PROBES and top < size:
        top += 1
    top = min(size, top + 2 * (axes > 1))
    return np.array(list(combinations(range(top), axes))), top


def cells_of(turned: np.ndarray, axes: int) -> np.ndarray:
    """The cells of each row, the own one first: sets of `axes` signed axes by the sum of their features, numbered."""
    subsets, top = _subsets(axes, turned.shape[1])
    size = np.abs(turned)
    largest = np.argpartition(-size, top - 1, axis=1)[:, :top] if top < turned.shape[1] else np.tile(np.arange(top), (len(turned), 1))
    value = np.take_along_axis(size, largest, axis=1)
    signed = 2 * largest + (np.take_along_axis(turned, largest, axis=1) < 0)
    score = value[:, subsets].sum(axis=2)
    most = min(PROBES, len(subsets))
    best = np.argsort(-score, axis=1, kind="stable")[:, :most]
    chosen = np.sort(np.take_along_axis(signed[:, None, :], subsets[best].reshape(len(turned), 1, -1), axis=2).reshape(len(turned), most, axes), axis=2)
    return (chosen.astype(np.int64) * (2 * turned.shape[1]) ** np.arange(axes)).sum(axis=2)


@lru_cache(maxsize=64)
def shared_cell(axes: int, size: int, least: float, pairs: int = 12_000) -> float:
    """The chance that two random vectors of cosine `least` share a cell of one turn, by simulation."""
    x, y = np.random.default_rng(7).standard_normal((2, pairs, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = least * x + np.sqrt(1 - least**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    hits = (cells_of(x, axes)[:, :, None] == cells_of(y, axes)[:, None, :]).any(axis=(1, 2)).sum()
    return min(max(int(hits), 1) / pairs, 0.9999)


def grid_shape(total: int, size: int, least: float = 0.65) -> tuple[int, int]:
    """(axes, turns). For every number of axes there are as many turns as give the chance MEET; the axes only weigh the
    cells a record is sent to against the strangers it meets there, whose number grows with the table."""

    def turns(axes: int) -> int:
        return max(1, int(np.ceil(np.log(1 - MEET) / (3 * np.log1p(-shared_cell(axes, size, least))))))

    def work(axes: int) -> float:
        strangers = total * min(1.0, min(PROBES, comb(size, axes)) ** 2 / (comb(size, axes) * 2.0**axes))
        return turns(axes) * (3.0 * PROBES + 0.02 * strangers)

    best = 2 if size > 2 else 1
    while best < min(5, size) and work(best + 1) < work(best):
        best += 1
    return best, turns(best)


def slack(size: int) -> float:
    """How much lower than the bar links may be: they compare vectors of four bits an element, whose cosines deviate from
    the exact ones by about 0.15 / sqrt(size)."""
    return 0.6 / size**0.5


def packed(units: np.ndarray) -> list[bytes]:
    """Rows in four bits an element, on a scale of their own."""
    levels = np.round(units / (np.abs(units).max(axis=1, keepdims=True) / 7)).astype(np.int8) + 8
    if levels.shape[1] % 2:
        levels = np.concatenate([levels, np.full((len(levels), 1), 8, np.int8)], axis=1)
    return [row.tobytes() for row in (levels[:, ::2] | levels[:, 1::2] << 4).astype(np.uint8)]


def unpacked(column) -> np.ndarray:
    both = unpack(column, len(column[0].as_py() if isinstance(column, pa.Array) else column.iloc[0]), np.uint8)
    rows = np.empty((len(both), 2 * both.shape[1]), np.float32)
    rows[:, ::2], rows[:, 1::2] = both & 15, both >> 4
    rows -= 8
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def quantised(vectors: DataFrame, size: int, axes: int, turns: int, first: int = 0) -> DataFrame:
    """(key, packed, cells): the cells of a record in some turns, PROBES or fewer each, the own one first in each turn."""
    base = rotation(size, 99)  # vectors are packed after a turn, so that no element is much larger than the others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wheels = [rotation(size, 100 + t).astype(np.float32) for t in range(first, first + turns)]
        for batch in batches:
            for s in range(0, len(batch), 4096):
                part = batch.slice(s, 4096)
                units = unit(unpack(part.column(1), size)).astype(np.float32)
                found = np.concatenate([cells_of(units @ w, axes) * 4096 + first + t for t, w in enumerate(wheels)], axis=1)
                offsets = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed(units @ base.astype(np.float32)), pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["key", "packed", "cells"])

    return vectors.select("key", "v").mapInArrow(run, "key bigint, packed binary, cells array<bigint>")


def _joined(low: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected to, after rows p and q are connected too."""
    while True:
        p, q = low[p], low[q]
        apart = p != q
        if not apart.any():
            return low
        p, q = p[apart], q[apart]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while ((lower := low[low]) != low).any():
            low = lower


def _unit_links(keys: np.ndarray, side: np.ndarray, rows: np.ndarray, starts: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all similar rows of each unit. A unit is a cell, or two tiles of one, whose sides are compared."""
    own, place = np.unique(keys, return_inverse=True)
    low = np.arange(len(own))
    for s, e in zip(starts[:-1], starts[1:]):
        if e - s < 2:
            continue
        second = side[s:e] == 1
        if second.any():
            left, right = s + np.flatnonzero(~second), s + np.flatnonzero(second)
            p, q = np.divmod(np.flatnonzero(rows[left] @ rows[right].T >= bar), max(1, len(right)))
            p, q = left[p], right[q]
        else:
            p, q = np.divmod(np.flatnonzero(rows[s:e] @ rows[s:e].T >= bar), e - s)
            p, q = p[p < q] + s, q[p < q] + s
        if len(p):
            low = _joined(low, place[p], place[q])
    linked = np.flatnonzero(low != np.arange(len(low)))
    return own[low[linked]], own[linked]


def dense_links(entries: DataFrame, bar: float) -> DataFrame:
    """(a, b) from (key, packed, cell): links that connect all records of each dense cell that reach the bar.

    Only cells of more than TILE records need their count before they are compared: they are cut into tiles, and each two
    tiles are a unit of their own, so that no task holds more than two tiles. Other cells are units as they are."""
    spark = entries.sparkSession
    crowded = cut(entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE).select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "crowded")
    placed = entries.join(crowded, "cell", "left")
    tile = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = placed.select("key", "packed", "cell", "tiles", tile.alias("tile"), other.alias("other"))
    unit_id = F.when(F.col("tiles").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("tile", "other"), F.greatest("tile", "other")))
    side = F.when(F.col("tile") > F.col("other"), 1).otherwise(0).cast("int")
    units = paired.select(unit_id.alias("unit"), "key", side.alias("side"), "packed")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compared(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            ids = table.column("unit").to_numpy()
            starts = np.r_[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(ids)]
            a, b = _unit_links(table.column("key").to_numpy(), table.column("side").to_numpy(), unpacked(table.column("packed").chunk(0)), starts, bar)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:  # sorted by unit: the last one of a batch may go on in the next
            if not len(batch):
                continue
            ids = batch.column(0).to_numpy()
            begun = int(np.searchsorted(ids, ids[-1]))
            if begun == 0 and held and held[-1].column(0)[-1].as_py() == ids[0]:
                held.append(batch)
                continue
            if begun or held:
                done = pa.Table.from_batches([*held, *([batch.slice(0, begun)] if begun else [])])
                yield compared(done)
            held = [batch.slice(begun)]
        if held:
            yield compared(pa.Table.from_batches(held))

    return units.repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(run, "a bigint, b bigint")


def grid_links(vectors: DataFrame, size: int, least: float, axes: int, turns: int) -> DataFrame:
    """The links of all turns, in rounds of bounded width, each written before the next begins."""
    step = max(1, ENTRIES // PROBES)
    rounds = []
    for t in range(0, turns, step):
        celled = cut(quantised(vectors, size, axes, min(step, turns - t), t), "cells")
        rounds.append(cut(dense_links(celled.select("key", "packed", F.explode("cells").alias("cell")), least - slack(size)).distinct(), "links"))
    return reduce(DataFrame.unionByName, rounds)


# exact comparison and division of connected sets


def _units(rows: pd.DataFrame, size: int) -> np.ndarray:
    return unit(unpack(rows["v"], size).astype(np.float64))


def _meet(left: DataFrame, right: DataFrame, find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `find` gives for every tile of `left` and every tile of `right` of the same label."""
    many = lambda df, name: df.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name))
    tiles = many(left, "lt").join(many(right, "rt"), "label")
    one = left.join(tiles, "label").withColumn("i", F.pmod(F.xxhash64("key"), F.col("lt")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rt") - 1)))
    two = right.join(tiles, "label").withColumn("j", F.pmod(F.xxhash64("key"), F.col("rt")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lt") - 1)))

    one, two = (df.select(*[F.col(c).alias(c) for c in df.columns if c not in ("lt", "rt")]) for df in (one, two))  # two datasets, even if both sides are one

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return find(a, b) if len(a) and len(b) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return one.groupBy("label", "i", "j").cogroup(two.groupBy("label", "i", "j")).applyInPandas(both, schema)


def _near(a: pd.DataFrame, b: pd.DataFrame, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(similar, cosines) of rows a and rows b; a row is not similar to itself."""
    cosines = _units(a, size) @ _units(b, size).T
    return (cosines >= least - TINY) & (a["key"].to_numpy()[:, None] != b["key"].to_numpy()[None, :]), cosines


def _small_whole(members: DataFrame, size: int) -> DataFrame:
    """(label, low): the least cosine within each set of at most TILE members."""

    def low(rows: pd.DataFrame) -> pd.DataFrame:
        units = _units(rows, size)
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "low": [float((units @ units.T).min())]})

    return members.groupBy("label").applyInPandas(low, "label bigint, low double")


def _large_whole(members: DataFrame, size: int, least: float) -> DataFrame:
    """(label, low) of larger sets, low below the bar if and only if some two members are. Members within half the bar's
    angle of their set's mean direction are similar to each other, so only the others are compared, with all."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                labels, at = np.unique(rows["label"], return_inverse=True)
                total = np.zeros((len(labels), size))
                np.add.at(total, at, _units(rows, size))
                yield pd.DataFrame({"label": labels, "s": list(total)})

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(rows["s"].to_numpy()).sum(axis=0)
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "mean": [(total / max(np.linalg.norm(total), 1e-12)).tobytes()]})

    means = members.select("label", "v").mapInPandas(sums, "label bigint, s array<double>").groupBy("label").applyInPandas(mean, "label bigint, mean binary")
    half = float(np.cos(np.arccos(np.clip(least, -1, 1)) / 2))

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                far = (_units(rows, size) * unpack(rows["mean"], size, np.float64)).sum(axis=1) < half + TINY
                yield rows[far][["label", "key", "v"]]

    outer = cut(members.select("label", "key", "v").join(means, "label").mapInPandas(outside, "label bigint, key bigint, v binary"), "outer")

    def low(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [a["label"].iloc[0]], "low": [float(_near(a, b, size, least)[1].min())]})

    compared = _meet(outer, members.select("label", "key", "v"), low, "label bigint, low double").groupBy("label").agg(F.min("low").alias("low"))
    return members.select("label").distinct().join(compared, "label", "left").select("label", F.coalesce("low", F.lit(1.0)).alias("low"))


def grown(keys: np.ndarray, to_leader: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The rows that join a leader: from the most similar to it on, each that is similar to all that joined before."""
    joined, fits = [], np.ones(len(keys), bool)
    for row in np.lexsort((keys, -np.round(to_leader, 9))):
        if fits[row]:
            joined.append(row)
            fits &= near[row]
    return np.array(joined, int)


def cliques(keys: np.ndarray, cosines: np.ndarray, least: float, smallest: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Labels of the disjoint groups of mutually similar rows in a connected set that is none itself, else -1.

    In each round the rows that have more similar rows than any they are similar to lead; smaller keys win ties. A row goes
    to the first of the leaders it is similar to, and a leader's group grows from those. Groups that a row outside could
    join whole are not closed and do not count; a leader that finds no group leads no more but may still join others.
    weights: how many records each row stands for."""
    near = cosines >= least - TINY
    np.fill_diagonal(near, False)
    weights = np.ones(len(keys), np.int64) if weights is None else weights
    labels, free, able = np.full(len(keys), -1, np.int64), np.ones(len(keys), bool), np.ones(len(keys), bool)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, -near.sum(axis=1)))] = np.arange(len(keys))
    none = len(keys)
    while (free & able).any():
        leads = np.flatnonzero(free & able)
        first = np.where(near[np.ix_(leads, leads)], rank[leads][None, :], none).min(axis=1)
        leaders = leads[rank[leads] < first]
        owner = np.where(near[leads[rank[leads] < first]], rank[leaders][:, None], none).min(axis=0)
        for leader in leaders:
            rows = np.flatnonzero(free & (owner == rank[leader]))
            group = np.r_[leader, rows[grown(keys[rows], cosines[leader, rows], near[np.ix_(rows, rows)])]]
            if weights[group].sum() < smallest:
                able[leader] = False
                continue
            further = near[:, group].all(axis=1)
            further[group] = False
            if not further.any():
                labels[group] = keys[group].min()
            free[group] = False
    return labels


def _divide_in_tables(sets: DataFrame, size: int, least: float, smallest: int) -> DataFrame:
    """What `cliques` gives, as (key, label), for sets (label, key, v, w) of any size: every comparison is between tiles,
    every round is written, and one task holds at most LARGE candidates of one group."""
    half = float(np.cos(np.arccos(np.clip(least, -1, 1)) / 2)) + TINY

    def degree(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": a["key"].to_numpy(), "degree": _near(a, b, size, least)[0].sum(axis=1)})

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near, _ = _near(a, b, size, least)
        degrees, keys = b["degree"].to_numpy(), b["key"].to_numpy()
        order = np.lexsort((keys, -degrees))
        found = near[:, order]
        some = np.flatnonzero(found.any(axis=1))
        at = order[found[some].argmax(axis=1)]
        return pd.DataFrame({"key": a["key"].to_numpy()[some], "behind": -degrees[at], "first": keys[at]})

    def led(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        near, cosines = _near(a, b, size, least)
        p, q = np.nonzero(near)
        return pd.DataFrame({"owner": a["key"].to_numpy()[p], "behind": -a["degree"].to_numpy()[p], "key": b["key"].to_numpy()[q], "cos": np.round(cosines[p, q], 9)})

    def all_near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        keys = b["key"].to_numpy()
        inside = np.isin(keys, a["key"].to_numpy())
        kept = _near(a, b, size, least)[0].all(axis=0) & ~inside
        return pd.DataFrame({"label": b["label"].to_numpy()[kept], "key": keys[kept], "i": a["i"].to_numpy()[:1].repeat(kept.sum())})

    def similar_to_all(group: DataFrame, rows: DataFrame) -> DataFrame:
        """(label, key) of rows similar to all rows of the group of their label."""
        sized = group.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("lt"))
        tiles = group.join(sized, "label").groupBy("label").agg(F.countDistinct(F.pmod(F.xxhash64("key"), F.col("lt"))).alias("tiles"))
        hits = _meet(group, rows, all_near, "label bigint, key bigint, i int").groupBy("label", "key").agg(F.countDistinct("i").alias("hits"))
        return hits.join(tiles, "label").where("hits = tiles").select("label", "key")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        near, _ = _near(rows, rows, size, least)
        joined = grown(rows["key"].to_numpy(), rows["cos"].to_numpy(), near)
        return rows.iloc[joined][["label", "key"]]

    def groups_of(candidates: DataFrame) -> DataFrame:
        """(label, key) of the rows that join each leader, from candidates (label = leader, key, cos, v)."""
        counts = candidates.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        few = candidates.join(counts.where(F.col("n") <= LARGE), "label").groupBy("label").applyInPandas(grow, "label bigint, key bigint")
        many = cut(candidates.join(counts.where(F.col("n") > LARGE).select("label"), "label"), "many")
        if many.limit(1).count() == 0:
            return few
        core = many.where(F.col("cos") >= half)  # within half the angle of the leader: similar to each other
        taken = core.select("label", "key")
        rest = many.where(F.col("cos") < half)
        rest = cut(rest.join(core.select("label").distinct(), "label", "left_anti").unionByName(rest.join(similar_to_all(core.select("label", "key", "v"), rest.select("label", "key", "v")), ["label", "key"], "left_semi")), "rest")
        while rest.limit(1).count():
            first = Window.partitionBy("label").orderBy(F.desc("cos"), "key")
            block = cut(rest.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= LARGE).drop("rn"), "block")
            joined = cut(block.groupBy("label").applyInPandas(grow, "label bigint, key bigint"), "joined")
            taken = taken.unionByName(joined)
            later = rest.join(block.select("label", "key"), ["label", "key"], "left_anti")
            new = joined.join(block.select("label", "key", "v"), ["label", "key"])
            rest = cut(later.join(similar_to_all(new, later.select("label", "key", "v")), ["label", "key"], "left_semi"), "rest")
        return few.unionByName(taken)

    rows = sets.select("label", "key", "v", "w")
    degrees = _meet(rows, rows, degree, "key bigint, degree bigint").groupBy("key").agg(F.sum("degree").alias("degree"))
    state = cut(rows.join(degrees, "key").withColumn("free", F.lit(True)).withColumn("able", F.lit(True)), "state")
    parts = []
    while state.where("free AND able").limit(1).count():
        leads = state.where("free AND able").select("label", "key", "v", "degree")
        ahead = _meet(leads, leads, best, "key bigint, behind bigint, first bigint").groupBy("key").agg(F.min(F.struct("behind", "first")).alias("ahead"))
        leaders = leads.join(ahead, "key", "left").where(F.col("ahead").isNull() | (F.struct((-F.col("degree")).alias("behind"), F.col("key").alias("first")) < F.col("ahead"))).drop("ahead")
        leaders = cut(leaders, "leaders")
        near = cut(_meet(leaders, state.select("label", "key", "v"), led, "owner bigint, behind bigint, key bigint, cos double"), "near")
        owned = near.join(state.where("free").select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct("behind", "owner", "cos")).alias("o"))
        candidates = owned.select(F.col("o.owner").alias("label"), "key", F.col("o.cos").alias("cos")).join(state.select("key", "v"), "key")
        joined = groups_of(candidates.select("label", "key", "cos", "v")).unionByName(leaders.select(F.col("key").alias("label"), "key"))
        joined = cut(joined.join(state.select("key", "v", "w"), "key"), "joined")
        enough = joined.groupBy("label").agg(F.sum("w").alias("n"), F.min("key").alias("name")).where(F.col("n") >= smallest)
        found = cut(joined.join(enough, "label").select("label", "key", "v", "name"), "found")
        around = near.select(F.col("owner").alias("label"), "key").join(state.select("key", "v"), "key")
        further = similar_to_all(found.select("label", "key", "v"), around.join(found.select("label").distinct(), "label", "left_semi").select("label", "key", "v"))
        open_ = further.join(found.select("label", "key"), ["label", "key"], "left_anti").select("label").distinct()
        parts.append(cut(found.join(open_, "label", "left_anti").select("key", F.col("name").alias("label")), "groups"))
        gone = found.select("key", F.lit(True).alias("gone"))
        spent = leaders.select("key", F.lit(True).alias("spent"))
        state = cut(
            state.join(gone, "key", "left").join(spent, "key", "left").select("label", "key", "v", "w", "degree", (F.col("free") & F.col("gone").isNull()).alias("free"), (F.col("able") & F.col("spent").isNull()).alias("able")), "state"
        )
    return reduce(DataFrame.unionByName, parts) if parts else sets.select("key", "label").limit(0)


def similar_groups(rows: DataFrame, key: str, column: str, size: int, least: float = 0.65, smallest: int = 4) -> DataFrame:
    """(key, label, n): the groups of at least `smallest` rows of which every two have a cosine of at least `least`.

    Null keys and vectors that are null, of another length, zero or not finite are left out; of several vectors of one
    key the smallest counts; exact copies under different keys are searched once and are members like any other. An empty
    table gives no rows. The grid is the same at every size but for its number of axes, and always turned so often that
    rows of a group meet with the chance MEET; what it links is checked exactly. Sets of any size are divided by one rule.
    """
    vectors = cut(usable_rows(rows, key, column, size).groupBy("key").agg(F.min(F.struct("v", "digest")).alias("x")).select("key", "x.v", "x.digest"), "vectors")
    members, single = collapsed_copies(vectors)
    copies = members.groupBy(F.col("rep").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    total = vectors.count()
    links = grid_links(single, size, least, *grid_shape(total, size, least))
    labels = minimum_labels(links).select(F.col("id").alias("key"), "label")
    alone = copies.join(labels, "key", "left_anti").select("key", F.col("key").alias("label"))
    weighed = cut(labels.unionByName(alone).join(copies, "key", "left").select("key", "label", F.coalesce("copies", F.lit(1)).alias("w")), "labels")
    sizes = weighed.groupBy("label").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("k")).where(F.col("n") >= smallest)
    sets = cut(weighed.join(sizes, "label").join(single.select("key", "v"), "key").select("label", "key", "v", "w", "n", "k"), "sets")

    lows = _small_whole(sets.where(F.col("k") <= TILE), size)
    if sets.where(F.col("k") > TILE).limit(1).count():
        lows = lows.unionByName(_large_whole(sets.where(F.col("k") > TILE), size, least))
    lows = cut(lows, "lows")
    whole = sets.join(lows.where(F.col("low") >= least - TINY).select("label"), "label", "left_semi").select("key", "label")
    broken = cut(sets.join(lows.where(F.col("low") < least - TINY).select("label"), "label", "left_semi"), "broken")

    def divide(group: pd.DataFrame) -> pd.DataFrame:
        units, keys = _units(group, size), group["key"].to_numpy(np.int64)
        found = cliques(keys, units @ units.T, least, smallest, group["w"].to_numpy(np.int64))
        return pd.DataFrame({"key": keys[found >= 0], "label": found[found >= 0]})

    divided = broken.where(F.col("k") <= LARGE).groupBy("label").applyInPandas(divide, "key bigint, label bigint")
    large = broken.where(F.col("k") > LARGE)
    if large.limit(1).count():
        divided = divided.unionByName(_divide_in_tables(large, size, least, smallest))
    reps = cut(whole.unionByName(divided), "reps")
    every = reps.join(members.withColumnRenamed("key", "copy"), reps["key"] == members["rep"], "left").select(F.coalesce("copy", "key").alias("key"), "label")
    return every.join(every.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("key", "label", "n")


def typical_members(groups: DataFrame, rows: DataFrame, key: str, column: str, size: int, members: int = 3, turns: int = 2) -> DataFrame:
    """(label, n, typical): each group with its size and its most typical members: those of its densest cell, over a few
    turns of the grid, that stand in the fullest cells on the whole, smaller keys first among equals. Cells are counted by
    an aggregation, so no group is held in one place."""
    vectors = usable_rows(rows, key, column, size).join(groups.select("key"), "key", "left_semi").groupBy("key").agg(F.min("v").alias("v"))
    own = quantised(vectors, size, min(2, size), turns).select("key", F.posexplode("cells").alias("at", "cell")).where(F.col("at") % min(PROBES, comb(size, min(2, size))) == 0).select("key", "cell")
    placed = cut(groups.join(own, "key").select("label", "n", "key", "cell"), "placed")
    counts = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("m"))
    densest = counts.groupBy("label").agg(F.max(F.struct(F.col("m"), (-F.col("cell")).alias("c"))).alias("d")).select("label", (-F.col("d.c")).alias("densest"))
    scored = placed.join(counts, ["label", "cell"]).join(densest, "label").groupBy("label", "key").agg(F.first("n").alias("n"), F.sum("m").alias("score"), F.max((F.col("cell") == F.col("densest")).cast("int")).alias("inside"))
    first = Window.partitionBy("label").orderBy(F.desc("inside"), F.desc("score"), "key")
    top = scored.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= members)
    return top.groupBy("label").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "key"))), lambda s: s["key"]).alias("typical"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(a, b) of all two members of one group, a < b."""
    return groups.select("label", F.col("key").alias("a")).join(groups.select("label", F.col("key").alias("b")), "label").where("a < b").select("a", "b")
