"""The engine's tables from stored artifacts: repeated deliveries removed, ids in one spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as X


def chunks(stored: DataFrame) -> DataFrame:
    """(book_id, chunk_id, ord, text), one row a chunk."""
    once = stored.where("book_id IS NOT NULL AND chunk_id IS NOT NULL").select("book_id", X.chunk_key(F.col("chunk_id")).alias("chunk_id"), "ord", "text")
    return once.groupBy("book_id", "chunk_id").agg(F.min("ord").alias("ord"), F.min("text").alias("text"))


def nodes(stored: DataFrame) -> DataFrame:
    """Tree nodes without vectors, one row a node."""
    return stored.select("node_key", "book_id", "node_id", "level", "text", "children", "leaves").dropDuplicates(["book_id", "node_id"])


def mentions(c2e: DataFrame) -> DataFrame:
    """(book_id, chunk_id, entity): distinct, entities in the index's spelling, short ones and pronouns dropped."""
    exploded = c2e.select("book_id", X.chunk_key(F.col("chunk_id")).alias("chunk_id"), F.explode("entities").alias("e"))
    return exploded.select("book_id", "chunk_id", X.entity_key(F.col("e")).alias("entity")).where(X.is_entity(F.col("entity"))).distinct()


def questions(predictions: DataFrame, pipeline: str | None = None) -> DataFrame:
    """(qid, pipeline, book_id, question, options, ground_truth), one row a question put to a pipeline."""
    rows = predictions if pipeline is None else predictions.where(F.col("pipeline") == pipeline)
    return rows.select(F.col("pred_id").alias("qid"), "pipeline", "book_id", "question", "options", "ground_truth").dropDuplicates(["qid"])


def tree_edges(tree: DataFrame) -> DataFrame:
    """(book_id, parent_id, child_id): distinct; children without a level prefix are leaves."""
    child = F.explode("children")
    rows = tree.where("level > 0").select("book_id", F.col("node_id").alias("parent_id"), child.alias("c"))
    return rows.where("c IS NOT NULL").select("book_id", "parent_id", F.when(F.col("c").rlike("^L[0-9]+_"), F.col("c")).otherwise(X.chunk_key(F.col("c"))).alias("child_id")).distinct()


VIEWS_SQL = f"""
ck AS (SELECT book_id, {X.Sql.chunk_key('chunk_id')} AS chunk_id, min(ord) AS ord, min(text) AS text FROM chunks WHERE book_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
nd AS (SELECT DISTINCT ON (book_id, node_id) node_key, book_id, node_id, level, text, children, leaves FROM nodes),
mn AS (SELECT DISTINCT book_id, chunk_id, entity FROM (SELECT book_id, {X.Sql.chunk_key('chunk_id')} AS chunk_id, {X.Sql.entity_key('e')} AS entity FROM (SELECT book_id, chunk_id, unnest(entities) AS e FROM i_c2e) u) v WHERE {X.Sql.is_entity('entity')}),
qa AS (SELECT DISTINCT ON (pred_id) pred_id AS qid, pipeline, book_id, question, options, ground_truth, ground_truth_text, prediction, raw_llm_output, retrieval_info FROM predictions),
te AS (SELECT DISTINCT book_id, parent_id, CASE WHEN regexp_matches(c, '^L[0-9]+_') THEN c ELSE 'L0_' || c END AS child_id FROM (SELECT book_id, node_id AS parent_id, unnest(children) AS c FROM nd WHERE level > 0) u WHERE c IS NOT NULL)
"""
