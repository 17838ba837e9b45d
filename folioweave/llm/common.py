"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions a frame before work in Python, into as many partitions as the session shuffles to and at least as
    many as there are cores: small inputs come in one file, and adaptive execution would join small partitions again. A
    hash, unlike a round robin, keeps retried tasks deterministic."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def once_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key and columns of rows with a key, one row a key, spread for work in Python by the one shuffle this takes."""
    return fan_out(df.where(df[key].isNotNull()).select(key, *columns), key).dropDuplicates([key])
