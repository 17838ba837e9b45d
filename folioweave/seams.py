"""The places where models plug in, and deterministic stand-ins: tokenizer, recogniser, embedder, summariser, relation
extractor, reranker, answer model. A model over rows is a function from batches of texts to batches of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave import prompts
from folioweave.functions import text as X
from folioweave.functions import vectors as V
from folioweave.operators.questions import distinct_tokens, share_of, token_overlap
from folioweave.operators.relations import adjacent_relations

TextModel = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], list[list[float]]]


def apply_texts(df: DataFrame, column: str, output: str, model: TextModel, batch: int = 100) -> DataFrame:
    """df with `output` = model(text), `batch` texts a call; a call that fails gives null for its texts."""
    return _apply(df, column, output, model, "string", batch)


def embed(df: DataFrame, column: str, output: str, model: Embedder, batch: int = 100) -> DataFrame:
    return _apply(df, column, output, model, "array<float>", batch)


def _apply(df: DataFrame, column: str, output: str, model: Callable, kind: str, batch: int) -> DataFrame:
    if batch < 1:
        raise ValueError("a batch needs at least one text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch].copy()
                try:
                    part[output] = list(model([t or "" for t in part[column]]))
                except Exception:
                    part[output] = None
                yield part

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{schema}, `{output}` {kind}")


@dataclass(frozen=True)
class Models:
    """Models that take texts: what `build_tree` and the pipelines call, made from functions over batches of texts."""

    complete: TextModel
    vectors: Embedder

    def summarise(self, df: DataFrame, level: int) -> DataFrame:
        return apply_texts(df.withColumn("prompt", prompts.summary(level, F.col("text"))), "prompt", "summary", self.complete)

    def embed(self, df: DataFrame) -> DataFrame:
        return embed(df, "text", "embedding", self.vectors)

    def relate(self, asked: DataFrame, mentions: DataFrame) -> DataFrame:
        return apply_texts(asked, "prompt", "raw", self.complete)

    def answer(self, df: DataFrame) -> DataFrame:
        """df with `raw`; a call that fails counts as the answer Z."""
        return apply_texts(df, "prompt", "raw", self.complete).withColumn("raw", F.coalesce("raw", F.lit("Z")))


@dataclass(frozen=True)
class StandIns:
    """Column expressions that take a model's place where results must be checkable."""

    def tokens(self, text: Column) -> Column:
        return X.words(text)

    def embedding(self, text: Column) -> Column:
        return V.letter_vector(text)

    def summary(self, text: Column, words: int = 40) -> Column:
        """The first words of a text."""
        return F.array_join(F.slice(X.words(text), 1, words), " ")

    def score(self, query: Column, text: Column) -> Column:
        return token_overlap(query, text)

    def summarise(self, df: DataFrame, level: int) -> DataFrame:
        return df.withColumn("summary", self.summary(F.col("text")))

    def embed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("embedding", self.embedding(F.col("text")).cast("array<float>"))

    def relate(self, asked: DataFrame, mentions: DataFrame) -> DataFrame:
        """asked with `raw`, a model's output: each entity of a chunk and the next one in order are related by 'next'.
        By a hash of the chunk the list comes plain, fenced or within a sentence, and broken off for a quarter of them."""
        bare = lambda c: F.translate(c, '"\\', "")
        item = F.concat(F.lit('{"source": "'), bare("source"), F.lit('", "relation": "next", "target": "'), bare("target"), F.lit('"}'))
        lists = adjacent_relations(mentions.join(asked.select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_semi")).groupBy("book_id", "chunk_id").agg(F.array_join(F.collect_list(item), ", ").alias("items"))
        kind = F.conv(F.substring(F.md5(F.concat("book_id", "chunk_id")), 1, 1), 16, 10).cast("int") % 4
        raw = (
            F.when(kind == 0, F.concat(F.lit("["), "items", F.lit("]")))
            .when(kind == 1, F.concat(F.lit("```json\n["), "items", F.lit("]\n```")))
            .when(kind == 2, F.concat(F.lit('Relations: ["stray", '), "items", F.lit("] as found.")))
            .otherwise(F.concat(F.lit("["), "items", F.lit(', {"source": "cut')))
        )
        return asked.join(lists.select("book_id", "chunk_id", raw.alias("raw")), ["book_id", "chunk_id"])

    def answer(self, df: DataFrame) -> DataFrame:
        """df (question, options, evidence, prompt) with `raw`: the option that shares most with the evidence, the first of
        equals; without options the evidence's first words."""
        known = distinct_tokens(F.col("evidence"))
        scored = df.withColumn("known__", known).withColumn("scores__", F.transform("options", lambda o: share_of(distinct_tokens(F.coalesce(o, F.lit(""))), F.col("known__"))))
        letter = F.chr(F.array_position("scores__", F.array_max("scores__")) + 64)
        return scored.withColumn("raw", F.when(F.size("options") > 0, F.concat(F.lit("Answer: "), letter)).otherwise(F.array_join(F.slice(X.words(F.col("evidence")), 1, 8), " "))).drop("known__", "scores__")

    def recognised(self, df: DataFrame, text: str) -> DataFrame:
        """df's keys with (label, name): capitalised words of a text, outer punctuation off; days are dates."""
        bare = F.transform(X.words(F.col(text)), lambda w: F.regexp_replace(w, r"^[.,;:!?()*#%\"'“”-]+|[.,;:!?()*#%\"'“”-]+$", ""))
        names = F.filter(bare, lambda w: w.rlike("^[A-Z][a-z]{2,}$"))
        return df.select(*[c for c in df.columns if c != text], F.explode(names).alias("name")).withColumn("label", F.when(F.col("name").endswith("day"), "DATE").otherwise("PERSON"))
