"""Splitting of oversized texts at natural boundaries, by agglomerative merging of atomic segments."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of the boundary after a segment; the weakest are merged first.
SECTION, PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, HARD = 6, 5, 4, 3, 2, 1, 0

#: A paragraph of at most so many characters that does not end as a sentence is a heading: text is cut before it, not after.
HEADING = 80

_BREAK = re.compile(
    r"(?P<par>\n(?:[^\S\n]*\n)+\s*)"
    r"|(?P<line>\n[^\S\n]*)"
    r"|(?P<sent>[.!?…][\"'”’»)\]]*\s+|[。！？][”’」』»)\]]*\s*)"
)
_CLAUSE = re.compile(r"[,;:–—][\"'”’»)\]]*\s+|[，；：、]")
_SPACE = re.compile(r"\s+|(?<=[_\-/])")


def _cuts(pattern: re.Pattern, text: str, start: int, end: int) -> list[int]:
    return [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]


def atoms(text: str, room: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary there) of the atomic segments, in order: sentences and lines; within longer ones
    clauses, then words, then equal runs of characters (not before a combining mark, where that can be helped)."""
    marks: list[tuple[int, int]] = []
    for m in _BREAK.finditer(text):
        strength = PARAGRAPH if m.lastgroup == "par" else LINE if m.lastgroup == "line" else SENTENCE
        if 0 < m.end() < len(text):
            marks.append((m.end(), strength))
    marks.append((len(text), PARAGRAPH))
    begun, opened = 0, -1
    for k, (end, strength) in enumerate(marks[:-1]):
        if strength == PARAGRAPH:
            words = text[begun:end].strip() if end - begun <= 4 * HEADING else ""
            if 0 < len(words) <= HEADING and words[-1] not in ".!?…。！？\"”’»」;,":
                marks[k] = (end, CLAUSE)
                if opened >= 0:
                    marks[opened] = (marks[opened][0], SECTION)
            begun, opened = end, k
    for pattern, strength in ((_CLAUSE, CLAUSE), (_SPACE, SPACE), (None, HARD)):
        finer: list[tuple[int, int]] = []
        start = 0
        for end, own in marks:
            if end - start > room:
                if pattern is not None:
                    inner = _cuts(pattern, text, start, end)
                else:
                    inner = _runs(text, start, end, room)
                finer.extend((cut, strength) for cut in inner)
            finer.append((end, own))
            start = end
        marks = finer
    return marks


def _runs(text: str, start: int, end: int, room: int) -> list[int]:
    import unicodedata

    pieces = -(-(end - start) // room)
    inner, at = [], start
    for left in range(pieces, 1, -1):
        cut = at + -(-(end - at) // left)
        low = max(at + 1, cut - 8, end - (left - 1) * room)
        back = cut
        while back > low and unicodedata.combining(text[back]):
            back -= 1
        cut = cut if unicodedata.combining(text[back]) else back
        inner.append(cut)
        at = cut
    return inner


def split_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text in code points, each at most `limit` long; each piece but the first repeats
    the last `overlap` characters before it, so that dropping the overlaps gives the text again. A text within the limit
    is one piece; an empty one none."""
    if not 0 <= overlap < limit:
        raise ValueError("needs 0 <= overlap < limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    room = limit - overlap
    marks = atoms(text, room)
    first = next(i for i, (end, _) in enumerate(marks) if end >= overlap)  # the first piece must hold the next one's overlap
    marks = marks[first:]
    n = len(marks)
    ends = [e for e, _ in marks]
    strengths = [s for _, s in marks]
    starts = [0, *ends[:-1]]
    after = list(range(1, n + 1))  # the next segment that is left, n at the end
    before = list(range(-1, n - 1))
    gone = [False] * n
    fits = lambda i, j: ends[j] - starts[i] <= (room if i else limit)  # noqa: E731  the first piece repeats nothing
    heap = [(strengths[i], ends[i + 1] - starts[i], i) for i in range(n - 1) if fits(i, i + 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i = heapq.heappop(heap)
        if gone[i] or (j := after[i]) == n or strengths[i] != strength or ends[j] - starts[i] != size:
            continue  # one of the two has changed since; its own entry follows
        ends[i], strengths[i], gone[j] = ends[j], strengths[j], True
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if fits(i, k):
                heapq.heappush(heap, (strengths[i], ends[k] - starts[i], i))
        if (h := before[i]) >= 0 and fits(h, i):
            heapq.heappush(heap, (strengths[h], ends[i] - starts[h], h))
    spans, i = [], 0
    while i < n:
        spans.append((max(0, starts[i] - overlap) if starts[i] else 0, ends[i]))
        i = after[i]
    return spans


PIECES = "field_name string, book_id string, chunk_id string, piece_no int, start_at int, end_at int, overlap int"


def split_oversized(texts: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of all texts over their limit.

    texts: field_name, book_id, chunk_id, text, max_chars, overlap_chars. Result: one row a piece with its place in
    the text (code points) and, if asked for, its text. Null and empty texts, texts within the limit and rows without a
    limit give no row. The same text delivered twice under one key is split once; two different texts of one key both
    are. Limits of which the overlap is not smaller than the size raise an error.
    """
    over = texts.where(F.length("text") > F.col("max_chars")).select("field_name", "book_id", "chunk_id", "text", F.col("max_chars").cast("int").alias("max_chars"), F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("overlap_chars"))
    once = over.withColumn("digest", F.sha2("text", 256)).dropDuplicates(["field_name", "book_id", "chunk_id", "digest"]).drop("digest")
    schema = PIECES + (", piece string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for field, book, chunk, text, limit, overlap in rows.itertuples(index=False):
                for no, (start, end) in enumerate(split_spans(text, int(limit), int(overlap))):
                    out.append((field, book, chunk, no, start, end, int(overlap) if no else 0, *([text[start:end]] if with_text else [])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return once.mapInPandas(run, schema)
