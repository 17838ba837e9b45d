"""Entity posting lists: chunk to entities, entity to chunks, and the same for summary nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.session import by_shuffle


def extract_mentions(recognised: DataFrame) -> DataFrame:
    """(book_id, chunk_id, entity) from a recogniser's output (book_id, chunk_id, label, name): labels kept, names in the
    index's spelling, short ones and pronouns dropped, each once a chunk."""
    rows = recognised.where(F.col("label").isin(*X.ENTITY_LABELS)).select("book_id", "chunk_id", X.entity_key(F.col("name")).alias("entity"))
    return rows.where(X.is_entity(F.col("entity"))).distinct()


def chunk_entities(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """(book_id, chunk_id, entities): sorted; chunks without entities keep an empty list."""
    lists = mentions.groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return chunks.select("book_id", "chunk_id").join(lists, ["book_id", "chunk_id"], "left").select("book_id", "chunk_id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def entity_chunks(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, entity, chunk_ids): in the order of the chunks."""
    placed = mentions.join(chunks.select("book_id", "chunk_id", "ord"), ["book_id", "chunk_id"])
    ordered = F.array_sort(F.collect_list(F.struct("ord", "chunk_id")))
    return placed.groupBy("book_id", "entity").agg(F.transform(ordered, lambda s: s["chunk_id"]).alias("chunk_ids"))


def node_entities(node_leaves: DataFrame, mentions: DataFrame) -> DataFrame:
    """(book_id, node_id, entity): the entities of a node's leaves, each once."""
    return node_leaves.join(by_shuffle(mentions), ["book_id", "chunk_id"]).select("book_id", "node_id", "entity").distinct()


def node_entity_lists(nodes: DataFrame, bridge: DataFrame) -> DataFrame:
    """(book_id, node_id, entities): sorted; nodes without entities keep an empty list."""
    lists = bridge.groupBy("book_id", "node_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return nodes.select("book_id", "node_id").join(lists, ["book_id", "node_id"], "left").select("book_id", "node_id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def entity_nodes(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("book_id", "entity").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))
