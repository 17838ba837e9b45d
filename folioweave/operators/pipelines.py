"""Whole pipelines: indexing of books, extraction of relations, and evaluation of both retrievals. All books at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.config import Adaptive, Indexing, Region
from folioweave.functions import text as X
from folioweave.operators import adaptive, chunking, postings, region, relations, tree
from folioweave.operators.questions import question_entities
from folioweave.prompts import ANSWER, fill
from folioweave.session import cut, stage
from folioweave.sources import readers


@dataclass(frozen=True)
class Index:
    """What indexing makes of books, and what both retrievals read."""

    chunks: DataFrame
    nodes: DataFrame
    tree_edges: DataFrame
    leaves: DataFrame
    mentions: DataFrame
    node_entities: DataFrame
    edges: DataFrame

    @property
    def texts(self) -> DataFrame:
        return self.nodes.select("book_id", "node_id", "level", "text")


def chunk_books(books: DataFrame, config: Indexing, normalise: bool = True) -> DataFrame:
    """(book_id, chunk_id, ord, text): token windows of the cleaned texts of (book_id, book_text)."""
    cleaned = books.where("book_id IS NOT NULL").select("book_id", X.clean_text(F.col("book_text"), normalise).alias("text"))
    windows = chunking.token_windows(cleaned, "book_id", "text", config.window, config.overlap)
    return windows.select(F.col("id").alias("book_id"), F.concat(F.lit("L0_chunk_"), F.col("ord").cast("string")).alias("chunk_id"), "ord", "text")


def extract_relations(chunks: DataFrame, mentions: DataFrame, models, cached: DataFrame | None = None, config: Indexing | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, results). Chunks with at least two entities that `cached` (book_id, chunk_id, items) does not cover are
    asked about; results has their parsed output, `items` null where it failed, which is not to be cached. Edges are
    merged from cached and new items together, validated against the chunk's entities and freed of repeats."""
    config = config or Indexing()
    eligible = relations.eligible_chunks(mentions)
    asked = relations.pending(eligible, cached) if cached is not None else eligible
    outputs = models.relate(relations.prompts(asked, chunks, mentions, config.prompt_chars), mentions)
    results = cut(relations.parse_output(outputs).select("book_id", "chunk_id", "items"), "relations")
    items = results if cached is None else results.unionByName(cached.select("book_id", "chunk_id", "items"))
    raw = items.where("items IS NOT NULL").select("book_id", "chunk_id", F.explode("items").alias("x")).select("book_id", "chunk_id", "x.source", "x.relation", "x.target")
    return relations.merge_edges(relations.dedup(relations.validate(raw, mentions))), results


def index_books(books: DataFrame, models, config: Indexing | None = None, cached: DataFrame | None = None, normalise: bool = True) -> Index:
    """Chunks, tree, mentions, postings and relations of (book_id, book_text). Books without text have nothing."""
    config = config or Indexing()
    chunks = cut(chunk_books(books, config, normalise), "chunks")
    nodes, edges = tree.build_tree(tree.leaf_nodes(chunks), models.summarise, models.embed, config)
    height = nodes.agg(F.max("level")).first()[0] or 1
    leaves = cut(tree.leaf_rollup(edges, nodes.where("level = 0"), max(1, height)), "leaves")
    mentions = cut(postings.extract_mentions(models.recognised(chunks.select("book_id", "chunk_id", "text"), "text")), "mentions")
    merged, _ = extract_relations(chunks, mentions, models, cached, config)
    return Index(chunks, nodes, edges, leaves, mentions, cut(postings.node_entities(leaves, mentions), "node_entities"), merged)


def unfinished(questions: DataFrame, done: DataFrame | None) -> DataFrame:
    """The questions of books without stored predictions."""
    return questions if done is None else questions.join(done.select("book_id").distinct(), "book_id", "left_anti")


def answered(questions: DataFrame, contexts: DataFrame, models, fallback: Column) -> DataFrame:
    """questions with evidence, prompt, raw_llm_output, prediction and ground_truth_text. contexts: qid, type, history,
    chunk_ids, context; a question without any has an empty one and is answered all the same."""
    rows = questions.join(contexts, "qid", "left").withColumn("evidence", F.coalesce("context", F.lit("")))
    listed = F.when(F.size("options") > 0, F.concat("question", F.lit("\nOptions:\n"), X.format_options(F.col("options")))).otherwise(F.col("question"))
    asked = rows.withColumn("prompt", fill(ANSWER, question=listed, evidence=F.col("evidence")))
    told = stage(models.answer(asked), "answers")  # a model is asked once
    letters = F.when(F.size("options") > 0, X.parse_answer(F.col("raw"))).otherwise(X.strip(F.col("raw")))
    info = F.struct(F.coalesce("type", F.lit("none")).alias("type"), F.coalesce("history", F.lit("")).alias("history"), F.coalesce("chunk_ids", F.lit("")).alias("chunk_ids"))
    return told.select("qid", "book_id", "question", "options", "ground_truth", X.truth_text(F.col("ground_truth"), F.col("options"), fallback).alias("ground_truth_text"), letters.alias("prediction"), F.col("raw").alias("raw_llm_output"), "evidence", "prompt", info.alias("retrieval_info"))


def evaluate_adaptive(questions: DataFrame, index: Index, models, config: Adaptive | None = None, done: DataFrame | None = None, mode: str = "all", start: int = 0, end: int = 0) -> DataFrame:
    """Answers by C1 of the questions (qid, book_id, question, options, ground_truth). Books in `done` are left out; `mode`
    picks books by number as `run_range` does."""
    asked = stage(_chosen_books(unfinished(questions, done), mode, start, end), "questions")
    entities = stage(question_entities(asked, index.mentions), "entities")
    evidence = stage(adaptive.retrieve(asked, entities, index.mentions, index.edges, index.texts, index.node_entities, config), "evidence")
    context = adaptive.context(evidence, asked, index.texts)
    contexts = adaptive.result(evidence).select("qid", F.col("mode").alias("type"), "history", "chunk_ids").join(context, "qid", "left")
    return answered(asked, contexts, models, F.col("ground_truth"))


def evaluate_region(questions: DataFrame, index: Index, models, config: Region | None = None, mode: str = "all", start: int = 0, end: int = 0) -> DataFrame:
    """Answers by C2, for all books anew."""
    asked = stage(_chosen_books(questions, mode, start, end), "questions")
    entities = stage(question_entities(asked, index.mentions), "entities")
    found = region.result(region.Stages(asked, entities, index.mentions, index.edges, index.texts, index.chunks, index.leaves, index.node_entities, config))
    contexts = found.select("qid", F.col("mode").alias("type"), F.lit("").alias("history"), "chunk_ids", "context")
    return answered(asked, contexts, models, F.lit(""))


def _chosen_books(questions: DataFrame, mode: str, start: int, end: int) -> DataFrame:
    if mode == "all":
        return questions
    number = F.expr("try_cast(element_at(split(book_id, '_'), -1) AS int)")
    return readers.run_range(questions.withColumn("book_no", number), mode, start, end).drop("book_no")
