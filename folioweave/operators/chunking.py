"""Chunking: token windows, sentences, and semantic chunks at outlying similarities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.functions import vectors as V


def token_windows(docs: DataFrame, id_column: str, text_column: str, window: int = 1200, overlap: int = 100) -> DataFrame:
    """(id, ord, n_tokens, text) of each document's windows of `window` tokens, each starting `window - overlap` after the
    one before, the last being the first that reaches the end. Blank windows go and ord closes up. Null and blank texts
    give no window. Raises ValueError unless 0 <= overlap < window."""
    if not 0 <= overlap < window:
        raise ValueError("needs 0 <= overlap < window")
    step = window - overlap
    tokens = docs.select(F.col(id_column).alias("id"), X.words(F.col(text_column)).alias("w")).where("size(w) > 0")
    count = (1 + F.ceil(F.greatest(F.lit(0), F.size("w") - window) / step)).cast("int")
    part = lambda i: F.slice("w", i * step + 1, F.lit(window))
    # all windows of a row are made before they are exploded, so that its tokens are not copied with each of them
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.size(part(i)).alias("n"), F.array_join(part(i), " ").alias("text")))
    return tokens.select("id", F.posexplode(windows).alias("ord", "x")).select("id", "ord", F.col("x.n").alias("n_tokens"), F.col("x.text").alias("text"))


def sentence_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, sentence) of each document."""
    return docs.select(F.col(id_column).alias("id"), F.posexplode(X.sentences(F.col(text_column))).alias("pos", "sentence"))


def adjacent_cosines(sentences: DataFrame) -> DataFrame:
    """(id, pos, sim): the cosine of each sentence's letter vector with the next one's, 0 where one is zero."""
    vectors = sentences.select("id", "pos", V.letter_vector(F.col("sentence")).alias("v"))
    following = F.lead("v").over(Window.partitionBy("id").orderBy("pos"))
    return vectors.withColumn("next", following).where("next IS NOT NULL").select("id", "pos", F.round(V.cosine(F.col("v"), F.col("next")), 9).alias("sim"))


def iqr_breakpoints(sims: DataFrame, factor: float = 1.5) -> DataFrame:
    """(id, pos): places after which a new chunk should start, the similarity there lying strictly below the lower fence."""
    fences = sims.groupBy("id").agg(F.percentile("sim", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select("id", F.round(F.col("q")[0] - factor * (F.col("q")[1] - F.col("q")[0]), 9).alias("fence"))
    return sims.join(fences, "id").where("sim < fence").select("id", "pos")


def semantic_chunks(sentences: DataFrame, breaks: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """(id, ord, first_pos, n_sentences, text): sentences are scanned in order; a chunk ends where a break follows and it
    has `least` sentences, where it has `most`, or at the end. A document of at most `least` sentences is one chunk.

    The scan runs once over sorted sentences in batches and holds one open chunk, however long a document is."""
    marked = sentences.join(breaks.withColumn("brk", F.lit(True)), ["id", "pos"], "left").select("id", "pos", "sentence", F.coalesce("brk", F.lit(False)).alias("brk"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, place, first, held = None, 0, 0, []

        def closed() -> tuple:
            return key, place, first, len(held), " ".join(held)

        for batch in batches:
            out = []
            for own, pos, sentence, brk in batch.itertuples(index=False):
                if own != key:
                    if held:
                        out.append(closed())
                    key, place, held = own, 0, []
                if not held:
                    first = pos
                held.append(sentence)
                if brk and len(held) >= least or len(held) >= most:
                    out.append(closed())
                    place, held = place + 1, []
            yield pd.DataFrame(out, columns=["id", "ord", "first_pos", "n_sentences", "text"])
        if held:
            yield pd.DataFrame([closed()], columns=["id", "ord", "first_pos", "n_sentences", "text"])

    kind = dict(sentences.dtypes)["id"]
    return marked.repartition("id").sortWithinPartitions("id", "pos").mapInPandas(scan, f"id {kind}, ord int, first_pos int, n_sentences int, text string")


METHODS = {"tokens": token_windows, "semantic_iqr": semantic_chunks}


def chunk(method: str, docs: DataFrame, id_column: str, text_column: str, **settings) -> DataFrame:
    """Chunks by a method's name: 'tokens' or 'semantic_iqr'; ValueError for any other."""
    if method == "tokens":
        return token_windows(docs, id_column, text_column, **settings)
    if method == "semantic_iqr":
        rows = sentence_rows(docs, id_column, text_column)
        return semantic_chunks(rows, iqr_breakpoints(adjacent_cosines(rows)), **settings)
    raise ValueError(f"unknown chunking method: {method}")
