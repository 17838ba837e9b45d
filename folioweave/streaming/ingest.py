"""Artifacts that arrive as a stream: repeated deliveries dropped within a watermark, edges merged batch by batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioweave.operators import graph
from folioweave.session import cut


def read_arrivals(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(arrivals: DataFrame, keys: list[str], time: str = "ingested_at", delay: str = "30 days") -> DataFrame:
    """Each key once while its state is kept: deliveries later than `delay` behind the newest one are dropped, so that the
    state stays bounded."""
    return arrivals.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def arrivals_per_window(arrivals: DataFrame, time: str = "ingested_at", length: str = "1 day", delay: str = "30 days") -> DataFrame:
    """Rows and books by event-time window, final once the watermark has passed it."""
    return arrivals.withWatermark(time, delay).groupBy(F.window(time, length)).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("book_id").alias("books")).select(F.col("window.start").alias("start"), "n", "books")


def merge_edge_stream(arrivals: DataFrame, path: str, checkpoint: str, time: str = "ingested_at") -> StreamingQuery:
    """Keeps an edge table up to date: each batch is normalised and upserted into the books it touches. A batch that is
    repeated after a failure gives the same table: of a triple's rows, stored or new, the one of the latest `time` stays."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        columns = ["book_id", "source", "relation", "target", "weight", "support_count", "chunk_ids", time]
        rows = graph.normalise_arrivals(batch, time).select(*columns)
        try:
            stored = spark.read.parquet(path).join(batch.select("book_id").distinct(), "book_id", "left_semi")
            rows = rows.unionByName(stored.select(*columns))
        except AnalysisException as error:  # the first batch finds no table
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        staged = cut(graph.upsert(rows, time), "merged")  # whole in the shared folder before any stored file is replaced
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)

    return arrivals.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
