"""Shared work on dense vectors: unit vectors, fixed rotations, coarse centroids fitted on a bounded sample."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import cut

#: The most rows that centroids and axes are fitted on. Every row is indexed; the fit only shapes the index.
FIT_ROWS = 60_000


def unpack(column, size: int, kind=np.float32) -> np.ndarray:
    """A column of packed vectors (pandas or Arrow) as a matrix."""
    parts = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), size)


def _rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of an array column's usable vectors, and those as a matrix."""
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(right)).flatten()
    rows = values.cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(len(right), size)  # a null element becomes NaN
    fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return right[fine], np.ascontiguousarray(rows[fine])


def usable_rows(df: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, v, digest) of the rows with a key and a usable vector: exactly `size` finite elements, not all zero. v: the
    vector's floats, packed; digest: 16 bytes that are the same for exact copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = _rows(batch.column(1), size)
            packed = [row.tobytes() for row in rows]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(packed, pa.binary()), pa.array(digests, pa.binary())], ["key", "v", "digest"])

    chosen = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<float>").alias("v"))
    return chosen.mapInArrow(run, "key bigint, v binary, digest binary")


def collapsed_copies(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, single) of vectors (key, v, digest). members: (rep, key) of all rows whose vector occurs under several keys,
    rep being the smallest of them; single: the vectors without the other copies."""
    ids = vectors.select("key", "digest").distinct()
    doubled = ids.groupBy("digest").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(ids.join(doubled, "digest").select("rep", "key"), "copies")
    return members, vectors.join(members.where("key <> rep").select("key"), "key", "left_anti")


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest element so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def sample_units(vectors: DataFrame, size: int, total: int) -> np.ndarray:
    """Unit vectors of a bounded sample of packed rows, chosen by a hash of their key."""
    every = max(1, -(-total // FIT_ROWS))
    rows = vectors.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("v").limit(2 * FIT_ROWS).toPandas()
    return unit(unpack(rows["v"].sort_values(), size).astype(np.float64))  # in a fixed order, whatever order the rows come in


def centroids(sample: np.ndarray, count: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a sample: `count` unit vectors."""
    rng = np.random.default_rng(seed)
    points = sample.astype(np.float32)
    centres = points[np.sort(rng.choice(len(points), min(count, len(points)), replace=False))].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(points[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(points), 8192)])
        order = np.argsort(nearest, kind="stable")
        counts = np.bincount(nearest, minlength=len(centres))
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(points[order], np.concatenate([[0], np.cumsum(counts[filled])[:-1]]), axis=0)
        centres[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres
