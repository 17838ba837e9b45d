"""Exact vector search: the k rows of most similar vectors for each query, by products over blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.session import by_shuffle

#: Query rows that one task holds at a time.
QUERY_BLOCK = 4096
#: Rows of a book that one task compares with a block of its queries.
ROW_BLOCK = 8192


def top_k(queries: DataFrame, rows: DataFrame, k: int, book: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, id, cos, place): for each query (qid, qv) the k rows (id, v) of highest cosine rounded to six places, ties to
    the smaller id. With `book`, both sides have that column and only rows of the same book count.

    The queries are the stated side. The queries and the rows of a book, or of all without one, are cut into blocks and
    each two blocks are compared in one task, which keeps k a query; the driver holds none. No pair beyond those is
    shuffled. Vectors of length zero are at cosine 0."""
    several = book is not None
    if not several:
        book = "book__"
        queries, rows = queries.withColumn(book, F.lit("")), rows.withColumn(book, F.lit(""))
    pairs = _bookwise(queries, rows, book, k + int(exclude_self), several)
    if exclude_self:
        pairs = pairs.where("qid <> id")
    order = Window.partitionBy("qid").orderBy(F.desc("cos"), "id")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("qid", "id", "cos", "place")


def _bookwise(queries: DataFrame, rows: DataFrame, book: str, k: int, several: bool) -> DataFrame:
    kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["id"]
    asked = queries.select(F.col(book).alias("book"), "qid", "qv").where("qv IS NOT NULL AND book IS NOT NULL")
    given = rows.select(F.col(book).alias("book"), "id", "v").where("v IS NOT NULL AND book IS NOT NULL")
    q_blocks = asked.groupBy("book").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("nq"))
    r_blocks = given.groupBy("book").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).alias("nr"))
    blocks = q_blocks.join(by_shuffle(r_blocks), "book")
    blocks = by_shuffle(blocks) if several else blocks
    left = asked.join(blocks, "book").select("book", "qid", "qv", F.pmod(F.xxhash64("qid"), F.col("nq")).alias("qb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nr") - 1)).alias("rb"))
    right = given.join(blocks, "book").select("book", "id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1)).alias("qb"), F.pmod(F.xxhash64("id"), F.col("nr")).alias("rb"))

    def compare(some: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(others):
            return pd.DataFrame({"qid": [], "id": [], "cos": []})
        return _best(some["qid"].to_numpy(), _units(some["qv"]), others["id"].to_numpy(), _units(others["v"]), k)

    keys = ("book", "qb", "rb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, f"qid {kinds[0]}, id {kinds[1]}, cos double")


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query and all rows that tie with the last of them."""
    cos = np.round(q @ v.T, 6) + 0.0
    most = min(k, cos.shape[1])
    edge = np.partition(cos, cos.shape[1] - most, axis=1)[:, cos.shape[1] - most]
    i, j = np.nonzero(cos >= edge[:, None])
    return pd.DataFrame({"qid": qids[i], "id": ids[j], "cos": cos[i, j]})


def _units(column) -> np.ndarray:
    rows = np.stack(column.to_numpy()).astype(np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
