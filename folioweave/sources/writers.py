"""Writers of artifacts: tables by book, caches that only grow, predictions, the graph, run times."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions import vectors as V
from folioweave.operators import graph


def write_table(df: DataFrame, root: str, name: str, by_book: bool = True) -> str:
    """A table by book under root/name; books in df replace their stored ones, all others stay. Rows go to tasks by ranges
    of book and a hash of the row, so that a book with most rows is written by several tasks and a small one by one."""
    path = f"{root}/{name}"
    plain = [c for c, kind in df.dtypes if c != "book_id" and "map<" not in kind and kind != "variant"]
    rows = df.repartitionByRange("book_id", F.xxhash64(*plain) if plain else F.lit(0)) if by_book else df
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("book_id") if by_book else writer).parquet(path)
    return path


def write_tree(nodes: DataFrame, root: str) -> None:
    """The tree's structure without vectors, and its unit vectors as a table of their own: what exact search reads."""
    write_table(nodes.drop("embedding"), root, "nodes")
    write_table(nodes.select("book_id", "node_id", V.unit(F.col("embedding")).alias("embedding_unit")), root, "node_vectors")


def append_results(results: DataFrame, root: str, name: str) -> DataFrame:
    """Adds the rows that did not fail to a cache keyed by book and chunk; a failed one (null items) is tried again later."""
    kept = results.where("items IS NOT NULL")
    kept.write.mode("append").parquet(f"{root}/{name}")
    return kept


def write_predictions(df: DataFrame, root: str, pipeline: str) -> str:
    """Predictions of a pipeline: C1 leaves books alone that are stored already, any other pipeline replaces them."""
    path = f"{root}/predictions_{pipeline}"
    if pipeline == "C1" and _exists(df.sparkSession, path):
        stored = df.sparkSession.read.parquet(path).select("book_id").distinct()
        df = df.join(stored, "book_id", "left_anti")
        df.write.mode("append").partitionBy("book_id").parquet(path)
        return path
    return write_table(df, root, f"predictions_{pipeline}")


def write_graph(edges: DataFrame, root: str, order: str | None = None, mentions: bool = True) -> None:
    """Entities, relations and mentions of a graph, idempotent: keys are unique and whole books replace themselves."""
    rows = graph.upsert(edges, order) if order else edges
    write_table(rows, root, "graph_relations")
    write_table(graph.entities(rows), root, "graph_entities")
    if mentions:
        write_table(graph.mentioned_in(rows), root, "graph_mentioned_in")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def timed(spark: SparkSession, root: str, stage: str) -> Iterator[None]:
    """Appends the seconds of the block to the table of run times, to four places."""
    began = time.time()
    yield
    spark.createDataFrame([(stage, round(time.time() - began, 4))], "stage string, seconds double").write.mode("append").parquet(f"{root}/run_times")
