"""Entities of questions, dense candidates, and scores shared by both retrieval pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.functions import vectors as V
from folioweave.operators.search import top_k
from folioweave.session import by_shuffle

#: Longest entity, in words, that the stand-in recogniser finds in a question.
LONGEST = 8
MARKS = "[?.,!;:¿]"


def question_entities(questions: DataFrame, mentions: DataFrame) -> DataFrame:
    """(qid, book_id, entity, pos): entities of the book's index whose words stand in the question, each once, with the
    place of the first one. All runs of up to LONGEST words are looked up by an equality join."""
    w = X.words(F.regexp_replace(F.lower("question"), MARKS, ""))
    words = questions.select("qid", "book_id", w.alias("w")).where("size(w) > 0")
    starts = words.select("qid", "book_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("pos"))
    runs = starts.select("qid", "book_id", "pos", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("w") - F.col("pos")))).alias("n"))
    grams = runs.select("qid", "book_id", "pos", F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ").alias("entity"))
    known = mentions.select("book_id", "entity").distinct()
    return grams.join(by_shuffle(known), ["book_id", "entity"]).groupBy("qid", "book_id", "entity").agg(F.min("pos").alias("pos"))


def dense(questions: DataFrame, node_texts: DataFrame, k: int) -> DataFrame:
    """(qid, node_id, cos, place): the k nodes of the question's book nearest to question and options."""
    asked = questions.select("qid", "book_id", V.letter_vector(X.dense_query(F.col("question"), F.col("options"))).alias("qv"))
    rows = node_texts.where("text IS NOT NULL AND text <> ''").select("book_id", F.col("node_id").alias("id"), V.letter_vector(F.col("text")).alias("v"))
    return top_k(asked, rows, k, book="book_id").withColumnRenamed("id", "node_id")


def entity_overlap(candidates: DataFrame, entities: DataFrame, node_entities: DataFrame) -> DataFrame:
    """candidates (qid, book_id, node_id, ...) with `overlap`, the number of the question's entities the node has, and
    `entity_list`, those entities sorted. Lists are compared, so that no pair of a candidate and an entity is shuffled; a
    question is of one book."""
    asked = entities.groupBy("qid", "book_id").agg(F.collect_set("entity").alias("asked"))
    held = node_entities.groupBy("book_id", "node_id").agg(F.collect_set("entity").alias("held"))
    pairs = candidates.select("qid", "book_id", "node_id").distinct().join(by_shuffle(asked), ["qid", "book_id"]).join(by_shuffle(held), ["book_id", "node_id"])
    lists = pairs.select("qid", "node_id", F.array_sort(F.array_intersect("asked", "held")).alias("entity_list")).where("size(entity_list) > 0")
    joined = candidates.join(by_shuffle(lists), ["qid", "node_id"], "left")
    return joined.withColumn("entity_list", F.coalesce("entity_list", F.array().cast("array<string>"))).withColumn("overlap", F.size("entity_list"))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(X.words(F.lower(text)))


def token_sets(node_texts: DataFrame) -> DataFrame:
    """(book_id, node_id, tokens) of nodes with text: what the stand-in reranker reads, made once a node, not once a pair."""
    return node_texts.where("text IS NOT NULL AND text <> ''").select("book_id", "node_id", distinct_tokens(F.col("text")).alias("tokens"))


def share_of(asked: Column, tokens: Column) -> Column:
    """The share of distinct tokens that are among others, to nine places; 0 if there are none."""
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, tokens)) / F.size(asked), 9)).otherwise(0.0)


def token_overlap(query: Column, text: Column) -> Column:
    """The stand-in reranker's score: the share of the query's distinct tokens that the text has."""
    return share_of(distinct_tokens(query), distinct_tokens(text))


def words_sql() -> str:
    return X.Sql.words(f"regexp_replace(lower(question), '{MARKS}', '', 'g')")


def token_overlap_sql(query: str, text: str) -> str:
    a = f"list_distinct({X.Sql.words(f'lower({query})')})"
    return f"CASE WHEN len({a}) > 0 THEN round(len(list_intersect({a}, {X.Sql.words(f'lower({text})')}))::DOUBLE / len({a}), 9) ELSE 0.0 END"
