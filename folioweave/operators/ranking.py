"""Places in an order without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.session import cut


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in its group by a total order; without keys all rows are one group.

    Rows are cut into ranges of groups and order, each range is numbered by itself, and the rows of a group's earlier
    ranges are added. So a group that holds most rows is spread over as many tasks as it has ranges."""
    ranged = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("range__", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "range__").orderBy(*order)
    counts = ranged.groupBy(*keys, "range__").agg(F.count(F.lit(1)).alias("n__"))  # a row a group and range
    before = F.sum("n__").over(Window.partitionBy(*keys).orderBy("range__")) - F.col("n__")
    offsets = counts.select(*keys, "range__", before.alias("before__"))
    numbered = ranged.withColumn("own__", F.row_number().over(within))
    return numbered.join(offsets, [*keys, "range__"]).withColumn(name, F.col("own__") + F.col("before__")).drop("range__", "own__", "before__")
