"""Scores of predictions: exact match, ROUGE-L, averages by dataset and pipeline, token usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioweave.functions import text as X

#: Datasets of multiple choice, for which exact match is the only score.
CHOICE = ("InfiniteChoice",)


def exact_match(prediction: Column, truth: Column) -> Column:
    """1.0 if both are alike in upper case without outer white space, else 0.0; a missing prediction counts as Z."""
    return (X.standardise(F.coalesce(prediction, F.lit("Z"))) == X.standardise(F.coalesce(truth, F.lit("")))).cast("double")


def _common(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, the table's rows being the bits of one number."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of the longest common subsequence of two arrays of words, 0 for a null one."""
    return pd.Series([_common(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int32")


def rouge_l(prediction: Column, truth: Column) -> Column:
    """The F score of the longest common subsequence of words, to four places; 0 for an empty side. Both as for exact
    match: in upper case, a missing prediction counts as Z."""
    a, b = X.words(X.standardise(F.coalesce(prediction, F.lit("Z")))), X.words(X.standardise(F.coalesce(truth, F.lit(""))))
    score = F.round(2 * common_length(a, b) / (F.size(a) + F.size(b)), 4)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def scored(predictions: DataFrame) -> DataFrame:
    """predictions with dataset, em and rl, both against `ground_truth`, or its text where that is missing; for the dataset
    of multiple choice rl is em."""
    truth = F.coalesce("ground_truth", "ground_truth_text")
    rows = predictions.withColumn("dataset", F.split("book_id", "_")[0]).withColumn("em", exact_match(F.col("prediction"), truth))
    return rows.withColumn("rl", F.when(F.col("dataset").isin(*CHOICE), F.col("em")).otherwise(rouge_l(F.col("prediction"), truth)))


def averages(scores: DataFrame, *by: str) -> DataFrame:
    rows = scores.groupBy(*by) if by else scores.groupBy()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("em"), 6), F.lit(0.0)).alias("em"), F.coalesce(F.round(F.avg("rl"), 6), F.lit(0.0)).alias("rl"))


def by_pipeline(scores: DataFrame) -> DataFrame:
    """Averages of each pipeline and of both pooled, the pooled row's pipeline being 'all'."""
    grouped = scores.groupingSets([["pipeline"], []], "pipeline").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("rl"), 6).alias("rl"), F.grouping("pipeline").alias("pooled"))
    return grouped.select(F.when(F.col("pooled") == 1, "all").otherwise(F.col("pipeline")).alias("pipeline"), "n", "em", "rl")


def token_usage(usage: DataFrame) -> DataFrame:
    """Tokens by book from (book_id, prompt_tokens, completion_tokens), null counts as none."""
    return usage.groupBy("book_id").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
