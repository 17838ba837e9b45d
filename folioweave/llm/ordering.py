"""Work over a total order without a single task: range buckets with offsets, and neighbours across buckets."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows sampled to place the bounds of range buckets. The bounds spread the work; no result depends on them.
BOUND_SAMPLE = 20_000


def text_buckets(df: DataFrame, column: str, buckets: int | None) -> DataFrame:
    """df with `bucket`: ranges of a string column's order, from the quantiles of a bounded sample of its hashes; as many
    as the rows need if their number is not given."""
    total = df.count()
    buckets = min(max(16, total // 50_000), BOUND_SAMPLE) if buckets is None else buckets
    if total == 0 or buckets < 2:
        return df.withColumn("bucket", F.lit(0))
    keep = max(1, total // BOUND_SAMPLE)
    sample = df.where(F.pmod(F.xxhash64(column), F.lit(keep)) == 0).select(F.substring(column, 1, 200).alias("t")).limit(4 * BOUND_SAMPLE)
    ranked = sorted(r.t for r in sample.collect() if r.t is not None)
    bounds = sorted({ranked[i * len(ranked) // buckets] for i in range(1, buckets)}) if ranked else []

    # the bounds go with the function, not into the plan, whose text the driver would hold with all of them once a stage
    @F.pandas_udf("int")
    def place(texts: pd.Series) -> pd.Series:  # Python sorts strings by code point, which is also the order of their UTF-8 bytes
        return pd.Series([None if t is None else bisect_right(bounds, t) for t in texts], dtype="Int32")

    return df.withColumn("bucket", place(column) if bounds else F.lit(0))


def next_in_order(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """df (distinct values in `column`) with `following`, the next greater value, also over bucket borders."""
    bucketed = text_buckets(df, column, buckets)
    own = bucketed.withColumn("following", F.lead(column).over(Window.partitionBy("bucket").orderBy(column)))
    firsts = bucketed.groupBy("bucket").agg(F.min(column).alias("first"))  # one row a bucket
    later = firsts.withColumn("next_first", F.lead("first").over(Window.orderBy("bucket"))).select("bucket", "next_first")
    return own.join(F.broadcast(later), "bucket").withColumn("following", F.coalesce("following", "next_first")).drop("next_first", "bucket")


def upper_ranks(values: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """(keys, value, n_le, n_ge, n): for each distinct value of each key group, how many rows have at most, and at least,
    that value, and how many rows the group has. Exact, by range buckets with partition offsets.

    Equal values are counted before anything is sorted. A group's values are cut into ranges at approximate quantiles,
    which only spread the work, each range is sorted by itself, and the counts of the lower ranges are added."""
    counted = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("m"))
    marks = counted.groupBy(*keys).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("marks"))
    placed = counted.join(marks, keys).withColumn("bucket", F.aggregate("marks", F.lit(0), lambda n, b: n + (F.col(value) > b).cast("int"))).drop("marks")
    totals = placed.groupBy(*keys, "bucket").agg(F.sum("m").alias("in_bucket"))
    by_key = Window.partitionBy(*keys)
    offsets = totals.select(*keys, "bucket", (F.sum("in_bucket").over(by_key.orderBy("bucket")) - F.col("in_bucket")).alias("offset"), F.sum("in_bucket").over(by_key).alias("n"))
    ranked = placed.join(offsets, [*keys, "bucket"]).withColumn("n_le", F.col("offset") + F.sum("m").over(Window.partitionBy(*keys, "bucket").orderBy(value)))
    return ranked.select(*keys, value, "n_le", (F.col("n") - F.col("n_le") + F.col("m")).alias("n_ge"), "n")


def at_least(column: Column, value: float) -> Column:
    return F.coalesce(column >= value, F.lit(False))
