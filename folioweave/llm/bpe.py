"""Encoding by a byte-level BPE vocabulary with backtracking over longest matches.

The usual encoder merges the best pair again and again. Here a word's tokens are found from left to right instead: a token
sequence is the encoder's own result exactly if each two neighbours stay as they are when encoded together. So the longest
token at each place is tried first, shorter ones after it, and places that lead nowhere are remembered, which makes the
whole linear in the word's length. Whether two tokens may stand side by side is computed once and memoised.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import once_by

#: The pattern that cuts a text into words before merging, fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries after which a memo starts afresh; bounds a worker's memory, changes no result.
MEMO = 400_000


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


class Encoder:
    """An encoder for a file of ranks (base64 token, rank). Bytes are mapped to the Latin-1 characters of the same value,
    so that an Aho-Corasick automaton over strings finds tokens over bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.words = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.find = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for word, rank in self.words.items():
            self.automaton.add_word(word, (len(word), rank))
        self.automaton.make_automaton()
        by_rank = sorted(self.words.items(), key=lambda x: x[1])
        size = by_rank[-1][1] + 1
        self.length = [0] * size
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        self.parts: list[tuple[int, int] | None] = [None] * size  # the pair a token is merged from
        self.merged: dict[tuple[int, int], int] = {}
        self.side: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        for word, rank in by_rank:
            self.length[rank] = len(word)
            self.shorter[rank] = next((self.words[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.words), -1)
        for word, rank in by_rank:
            for k in range(len(word) - 1, 0, -1):
                left, right = self.words.get(word[:k], size), self.words.get(word[k:], size)
                if left < rank and right < rank and self._stay(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        self.side.clear()

    def _stay(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded together, come out as they are: no merge over their border may come first.
        The tokens are taken apart in the reverse order of their merges; `bound` is the merge undone last."""
        bound, undone_left = 1 << 60, False
        parts, merged = self.parts, self.merged
        while True:
            joint = merged.get((left, right))
            # A merge over the border wins against the undone one if it has the lower rank; of equal rank, the left place wins.
            if joint is not None and (joint < bound or joint == bound and not undone_left):
                return False
            a, b = parts[left], parts[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                bound, undone_left, left = left, True, a[1]
            elif a is None or right > left:
                bound, undone_left, right = right, False, b[0]
            else:  # the same token on both sides: of equal merges the left one came first, so the right one is undone first
                bound, undone_left, right = right, False, b[0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.side.get(key)
        if known is None:
            if len(self.side) >= MEMO * 4:
                self.side.clear()
            known = self.side[key] = self._stay(left, right)
        return known

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word given as Latin-1 characters of its bytes."""
        if (whole := self.words.get(word)) is not None:
            return [whole]
        n = len(word)
        longest = [-1] * n
        for end, (size, rank) in self.automaton.iter(word):
            start = end - size + 1
            if longest[start] < 0 or self.length[longest[start]] < size:
                longest[start] = rank
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        length, shorter = self.length, self.shorter
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < n:
                    token = longest[at]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        if not text:
            return []
        memo, out = self.memo, []
        for word in self.find(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.encode_word(word.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(word) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[word] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _mapped(df: DataFrame, id_column: str, text_column: str, path: str, count_only: bool) -> DataFrame:
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, len(batch), 1000):
                part = [own.encode(t) for t in texts.slice(start, 1000).to_pylist()]
                result = pa.array([len(x) for x in part], pa.int64()) if count_only else pa.array(part, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 1000), result], [id_column, "n_tokens" if count_only else "ids"])

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, " + ("n_tokens bigint" if count_only else "ids array<int>"))


def token_ids(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids) of each row. An empty or null text has the empty list; rows that are repeated stay repeated. Texts of any
    length are encoded whole. Extra columns are ignored. `vocabulary`: path of a rank file that all executors can read."""
    return _mapped(df, id_column, text_column, vocabulary or default_vocabulary(), False)


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens) of each row, 0 for an empty or null text."""
    return _mapped(df, id_column, text_column, vocabulary or default_vocabulary(), True)


def add_token_counts(df: DataFrame, text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """df with `n_tokens` of a text column, 0 for an empty or null text; a column of that name is replaced."""
    path = vocabulary or default_vocabulary()
    df = df.drop("n_tokens")
    place = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts = pa.array([len(own.encode(t)) for t in batch.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*batch.schema.names, "n_tokens"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", n_tokens bigint")


def once(documents: DataFrame) -> DataFrame:
    """Documents without repeated deliveries of the same id."""
    return once_by(documents, "doc_id", "text")


def frequencies(ids: DataFrame) -> DataFrame:
    """(token, n): how often each token occurs in the corpus."""
    return ids.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
