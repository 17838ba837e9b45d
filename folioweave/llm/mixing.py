"""Mixing sources to target shares of tokens, by soft membership.

A classifier trained on labelled documents gives each document its probabilities of the domains by its text. Projected
gradient fits nonnegative rates so that the domains' expected token totals, by membership, and the sources' own totals
match their targets; the sums it needs are aggregated over all documents once. Rates become whole copies, and a last step
makes up for what rounding left over, so the shares asked for by source hold up to one document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.llm.common import once_by
from folioweave.session import cut

#: The classifier is fitted on at most so many documents of each source, chosen by a hash of their id.
FIT_DOCUMENTS = 200
#: Hashed word features of the classifier.
FEATURES = 4096
#: Levels of the likeliest domain's probability that cells tell apart.
LEVELS = 8
#: Documents of a bucket in which a running total is summed.
BUCKET_ROWS = 20_000


def _slot(word: str) -> int:
    """The feature of a word: digits and capitalised words count by their shape, others by themselves."""
    shape = "9" if word.isdigit() else "A" if word[:1].isupper() else word.lower()
    return zlib.crc32(shape.encode("utf-8", "replace")) % FEATURES


_slot_kept = lru_cache(maxsize=200_000)(_slot)
_TOKEN = re.compile(r"\w+|[^\w\s]|\n")


def _features(texts: list[str | None]) -> np.ndarray:
    """Hashed counts of words and signs, damped and scaled to length 1."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        slots = [_slot_kept(w) if len(w) <= 64 else _slot(w) for w in _TOKEN.findall(text or "")]
        if slots:
            out[i] = np.bincount(slots, minlength=FEATURES)
    np.log1p(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_domains(documents: DataFrame, sources: list[str], seed_rounds: int = 60) -> np.ndarray:
    """Weights (FEATURES + 1, sources) of a softmax classifier fitted on a bounded sample of labelled documents."""
    known = documents.where(F.col("source").isin(sources) & F.col("text").isNotNull())
    first = Window.partitionBy("source").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = known.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= FIT_DOCUMENTS).select("text", "source").toPandas()
    weights = np.zeros((FEATURES + 1, len(sources)), np.float32)
    if len(sample) == 0 or len(sources) < 2:
        return weights
    x = np.concatenate([_features(sample["text"].tolist()), np.ones((len(sample), 1), np.float32)], axis=1)
    y = np.eye(len(sources), dtype=np.float32)[[sources.index(s) for s in sample["source"]]]
    for _ in range(seed_rounds):
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= 4.0 * (x.T @ (p - y) / len(x) + 1e-4 * weights)
    return weights


def memberships(documents: DataFrame, weights: np.ndarray, sources: list[str]) -> DataFrame:
    """(doc_id, source, tokens, m, cell): for each document its probabilities of the domains by its text alone, and the
    cell it shares with others of its source that have the same likeliest domain with about the same probability."""
    place = {s: i for i, s in enumerate(sources)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), 500):
                part = rows.iloc[start : start + 500]
                z = np.concatenate([_features(part["text"].tolist()), np.ones((len(part), 1), np.float32)], axis=1) @ weights
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                own = np.array([place[s] for s in part["source"]])
                level = np.minimum((p.max(axis=1) * LEVELS).astype(int), LEVELS - 1)
                cell = (own * len(sources) + p.argmax(axis=1)) * LEVELS + level
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), "tokens": part["tokens"].to_numpy(), "m": list(p.astype(np.float64)), "cell": cell.astype(np.int32)})

    return documents.select("doc_id", "text", "source", "tokens").mapInPandas(run, "doc_id bigint, source string, tokens bigint, m array<double>, cell int")


def mixture_size(per_source: dict[str, tuple[float, int]], shares: dict[str, float]) -> float:
    """The largest total of tokens at which every source with documents can have its share: (tokens, repeats) by source."""
    return min((tokens * repeats / shares[s] for s, (tokens, repeats) in per_source.items() if shares[s] > 0), default=0.0)


def fit_rates(tokens: np.ndarray, expected: np.ndarray, own: np.ndarray, start: np.ndarray, cap: np.ndarray, targets: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The rate of each cell by projected gradient, within 0 and its cap, from its tokens, its expected tokens of each
    domain (cells, domains) and the place of its source.

    Two sets of totals are to match the targets, in least squares of their relative gaps: those of the domains, as the
    texts' memberships expect them, and those of the sources. There are far more cells than totals, so both can be met as
    far as the caps allow. Scaled by its start rate a cell's gradient is the gaps weighed by its shares of the totals."""
    size, scale = len(targets), np.maximum(targets, 1.0)
    parts = np.concatenate([expected, tokens[:, None] * np.eye(size)[own]], axis=1)  # a cell's part in each total at rate 1
    goals, scales = np.r_[targets, targets], np.r_[scale, scale]
    lean = parts / np.maximum(tokens, 1e-9)[:, None]
    rate, best, least = np.clip(start, 0, cap), np.clip(start, 0, cap), np.inf
    for _ in range(rounds):
        gap = (goals - rate @ parts) / scales
        gap[size:] *= 4  # the sources' shares are what is asked for
        loss = float((gap**2).sum())
        if loss < least:
            best, least = rate, loss
        if np.abs(gap).max() < 1e-5:
            break
        rate = np.clip(rate + 0.2 * np.maximum(start, 1e-3) * (lean @ gap), 0, cap)
    return best


def mix(documents: DataFrame, add_counts: Callable[[DataFrame], DataFrame], targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: doc_id, source, n_tokens, copies for each document used; report: source, target_share,
    available tokens, mixture tokens, actual_share and the most copies of one document, for every source with a target, and
    beside them fitted_share, what the rates give it before they are whole, and expected_share, what the memberships
    expect of its domain.

    documents: doc_id, source, text; add_counts: adds `n_tokens` to them; targets: source, target_share, max_repeats.
    Repeated doc_ids count once; documents without tokens or of sources without a target are not used. The total is the largest at which
    each source that has documents reaches its share within its repeats; the shares of sources without any document fall
    to the others in proportion, and their actual share is 0. Null shares and repeats count as 0 and 1. The rates are
    fitted on sums over cells, at most sources x sources x LEVELS rows, that all documents are aggregated to.
    """
    spark = documents.sparkSession
    wanted = {r.source: (float(r.target_share or 0.0), int(r.max_repeats or 1)) for r in targets.where("source IS NOT NULL").dropDuplicates(["source"]).collect()}  # a fixed list
    sources = sorted(s for s, (share, _) in wanted.items() if share > 0)
    once = once_by(documents.where(F.col("source").isin(sources)), "doc_id", "source", "text")
    sized = cut(add_counts(once).withColumnRenamed("n_tokens", "tokens").where("tokens > 0"), "sized")
    counted = sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()  # one row a source
    available = {r.source: float(r.t) for r in counted}
    whole = sum(wanted[s][0] for s in available) or 1.0
    shares = {s: wanted[s][0] / whole for s in available}
    total = mixture_size({s: (available[s], wanted[s][1]) for s in available}, shares)
    live = sorted(available)
    fitted, expected = dict.fromkeys(live, 0.0), dict.fromkeys(live, 0.0)
    if live:
        goals = np.array([shares[s] * total for s in live])
        soft = cut(memberships(sized, fit_domains(sized, live), live), "soft")
        cells = soft.groupBy("cell").agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * F.col("m")[d]).alias(f"d{d}") for d in range(len(live))]).toPandas().sort_values("cell")
        tokens, sums = cells["t"].to_numpy(float), cells[[f"d{d}" for d in range(len(live))]].to_numpy(float)
        own = cells["cell"].to_numpy() // (len(live) * LEVELS)
        cap = np.array([wanted[s][1] for s in live], float)[own]
        rate = fit_rates(tokens, sums, own, (goals / np.array([available[s] for s in live]))[own], cap, goals)
        mass = max(float(rate @ tokens), 1e-9)
        fitted = dict(zip(live, np.bincount(own, weights=rate * tokens, minlength=len(live)) / mass))
        expected = dict(zip(live, (rate @ sums) / mass))
        rates = spark.createDataFrame(pd.DataFrame({"cell": cells["cell"].astype("int32"), "rate": rate, "cap": cap.astype("int32"), "goal": goals[own]}), "cell int, rate double, cap int, goal double")
        rated = soft.select("doc_id", "source", "tokens", "cell").join(F.broadcast(rates), "cell")  # at most sources x sources x LEVELS rows
    else:
        rated = sized.select("doc_id", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("cap"), F.lit(0.0).alias("goal"))
    buckets = max(64, sum(r.n for r in counted) // BUCKET_ROWS)
    mixture = _settle(_whole_copies(rated.select("doc_id", "source", "tokens", "cap", "goal", "rate"), buckets), buckets)
    mixture = mixture.where("copies > 0").select("doc_id", "source", F.col("tokens").alias("n_tokens"), "copies")
    limits = spark.createDataFrame([(s, wanted[s][0], available.get(s, 0.0), float(fitted.get(s, 0.0)), float(expected.get(s, 0.0))) for s in sources], "source string, target_share double, available double, fitted double, expected double")
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    everything = F.sum("used").over(Window.partitionBy())  # one row a source
    report = limits.join(used, "source", "left").select(
        "source", "target_share", F.col("available").cast("bigint").alias("available_tokens"), F.round("expected", 6).alias("expected_share"), F.round("fitted", 6).alias("fitted_share"),
        F.coalesce("used", F.lit(0)).cast("bigint").alias("mixture_tokens"), F.coalesce(F.round(F.col("used") / everything, 6), F.lit(0.0)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).cast("int").alias("most_copies"),
    )
    return mixture, report


def _running(rows: DataFrame, size: Column, order: str, buckets: int) -> DataFrame:
    """rows with `upto`, the running total of `size` in its source by a hash order, summed by hash buckets with offsets."""
    placed = rows.withColumn("size__", size).withColumn("bucket", F.pmod(F.shiftright(order, 32), F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size__").alias("w"))
    offsets = sums.select("source", "bucket", (F.sum("w").over(Window.partitionBy("source").orderBy("bucket")) - F.col("w")).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy(order, "doc_id")
    return placed.join(offsets, ["source", "bucket"]).withColumn("upto", F.col("offset") + F.sum("size__").over(inside)).drop("offset", "bucket", "size__")


def _whole_copies(rated: DataFrame, buckets: int) -> DataFrame:
    """Whole copies from rates: the whole part of a rate, and one more for documents at which the running total of the
    parts left over passes a multiple of the document's tokens, so that these parts come out at their sum."""
    rows = cut(rated.withColumn("order", F.xxhash64("doc_id")).withColumn("part", F.col("rate") - F.floor("rate")), "rated")
    own = F.col("part") * F.col("tokens")
    step = lambda x: F.floor(x / F.col("tokens") + 0.5)
    extra = F.when(step(F.col("upto")) > step(F.col("upto") - own), 1).otherwise(0)
    return _running(rows, own, "order", buckets).select("doc_id", "source", "tokens", "cap", "goal", "order", F.least(F.col("cap"), (F.floor("rate") + extra).cast("int")).alias("copies"))


def _settle(rough: DataFrame, buckets: int) -> DataFrame:
    """Adds or drops single copies, in a fixed order, until a source's total is within a document of its goal: what rounding
    has left over."""
    rough = cut(rough, "rough")
    gaps = rough.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("have"), F.first("goal").alias("aim"))
    rows = rough.join(F.broadcast(gaps), "source").withColumn("gap", F.col("aim") - F.col("have"))  # one row a source
    able = rows.withColumn("free", F.when(F.col("gap") > 0, (F.col("copies") < F.col("cap")).cast("int")).otherwise((F.col("copies") > 0).cast("int")))
    upto = _running(able.withColumn("order2", F.xxhash64("order", F.lit("settle"))), F.col("free") * F.col("tokens"), "order2", buckets)
    moved = (F.col("free") == 1) & (F.col("upto") - F.col("tokens") / 2 <= F.abs("gap"))
    change = F.when(moved & (F.col("gap") > 0), 1).when(moved & (F.col("gap") < 0), -1).otherwise(0)
    return upto.withColumn("copies", F.col("copies") + change)
