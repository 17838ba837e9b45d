"""Relations: which chunks are asked, parsing of model output, validation, merge to weighted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.operators.ranking import placed
from folioweave.prompts import RELATION, fill


def eligible_chunks(mentions: DataFrame) -> DataFrame:
    """(book_id, chunk_id, n_entities) of chunks with at least two entities."""
    return mentions.groupBy("book_id", "chunk_id").agg(F.countDistinct("entity").alias("n_entities")).where("n_entities >= 2")


def pending(eligible: DataFrame, cached: DataFrame) -> DataFrame:
    """The eligible chunks that no cached result covers."""
    return eligible.join(cached.select("book_id", "chunk_id").distinct(), ["book_id", "chunk_id"], "left_anti")


def prompts(eligible: DataFrame, chunks: DataFrame, mentions: DataFrame, limit: int = 8000) -> DataFrame:
    """(book_id, chunk_id, prompt): the entities asked about and the chunk's text, cut to `limit` characters as a model's
    window demands."""
    named = mentions.join(eligible.select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_semi").groupBy("book_id", "chunk_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), ", ").alias("names"))
    text = F.substring(F.coalesce("text", F.lit("")), 1, limit)
    return named.join(chunks, ["book_id", "chunk_id"]).select("book_id", "chunk_id", fill(RELATION, entities=F.col("names"), text=text).alias("prompt"))


def parse_output(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Model output to relations: adds `failed` (no list or broken JSON; not to be cached) and `items`, an array of
    (source, relation, target), null where a field is missing. Fences and text around the list are tolerated, elements
    that are no objects give null fields, an empty text and a JSON value that is no list give an empty array.

    The whole list must be one JSON value: a bare lenient parse would accept text after it."""
    inner = F.regexp_extract(F.col(raw), r"(?s)\[.*\]", 0)
    blank = F.coalesce(F.trim(F.regexp_replace(F.col(raw), r"\s+", " ")) == "", F.lit(False))
    strict = F.expr("try_parse_json(concat('{\"a\":', __m, '}')) IS NOT NULL AND coalesce(json_array_length(concat('[', __m, ']')), 0) = 1")
    parsed = outputs.withColumn("__m", inner).withColumn("__ok", (F.col("__m") != "") & strict)
    elements = F.expr("CASE WHEN __ok THEN cast(try_parse_json(__m) AS array<variant>) END")
    field = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    items = F.transform("__e", lambda v: F.struct(field(v, "source").alias("source"), field(v, "relation").alias("relation"), field(v, "target").alias("target")))
    empty = F.array().cast("array<struct<source:string,relation:string,target:string>>")
    done = parsed.withColumn("__e", elements).withColumn("items", F.when(F.col("__ok"), items).when(blank, empty)).withColumn("failed", F.col("items").isNull())
    return done.drop("__m", "__ok", "__e")


def validate(raw: DataFrame, mentions: DataFrame) -> DataFrame:
    """(book_id, chunk_id, source, relation, target): complete relations in the relation side's spelling whose ends are
    both entities of their chunk and not the same."""
    ends = mentions.select("book_id", "chunk_id", X.relation_entity_key(F.col("entity")).alias("e")).distinct()
    rows = raw.where("source <> '' AND relation <> '' AND target <> ''").select(
        "book_id", "chunk_id", X.relation_entity_key(F.col("source")).alias("source"), X.relation_key(F.col("relation")).alias("relation"), X.relation_entity_key(F.col("target")).alias("target")
    )
    rows = rows.where("source <> target")
    known = rows.join(ends.withColumnRenamed("e", "source"), ["book_id", "chunk_id", "source"], "left_semi")
    return known.join(ends.withColumnRenamed("e", "target"), ["book_id", "chunk_id", "target"], "left_semi").select("book_id", "chunk_id", "source", "relation", "target")


def dedup(relations: DataFrame) -> DataFrame:
    return relations.dropDuplicates(["book_id", "chunk_id", "source", "relation", "target"])


def merge_edges(relations: DataFrame) -> DataFrame:
    """(book_id, source, relation, target, weight, chunk_ids): one edge for each triple, its weight the number of its
    relations, its evidence the distinct chunks."""
    return relations.groupBy("book_id", "source", "relation", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def by_weight(edges: DataFrame) -> DataFrame:
    """All edges with their place in their book, heaviest first; ties by source, relation, target."""
    return placed(edges, ["book_id"], [F.desc("weight"), F.col("source"), F.col("relation"), F.col("target")])


def adjacent_relations(mentions: DataFrame) -> DataFrame:
    """The stand-in extractor: each entity of a chunk and the next one in order are related by 'next'."""
    lists = mentions.groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("e")).where("size(e) >= 2")
    pairs = lists.select("book_id", "chunk_id", F.posexplode(F.slice("e", 1, F.size("e") - 1)).alias("i", "source"), "e")
    return pairs.select("book_id", "chunk_id", "source", F.lit("next").alias("relation"), F.element_at("e", F.col("i") + 2).alias("target"))
