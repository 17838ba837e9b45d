"""Text quality statistics of each document, its outlier score, and its kind: prose, list, table or junk.

The statistics are ranked exactly within each language by range-partitioned sorting with partition offsets; the two tail
probabilities that the ranks give are combined over the statistics into outlier scores. The scores give the candidates of
each kind; an exact check by the kind's definition follows, and near the border to junk the outlier score decides again.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import once_by
from folioweave.llm.ordering import upper_ranks
from folioweave.session import cut

_MARK = re.compile(r"^(?:[-*•·→▪◦‣–—+>]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxlcdmIVXLCDM]{1,7})[.)、:])\s+\S|^[•→·▪◦‣－]\S|^\d{1,4}[.)、]\S")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»“」』)\]*_]*$|[.!?。！？]\s*[”»“]\s*\S{0,3}$")
_SENTENCE = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TAG = re.compile(r"<[^<>\n]+>|&[a-zA-Z]{2,8};|&#\d+;")
_RULE = re.compile(r"^[\s|+\-=:_]+$")
_CJK = re.compile(r"[㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_DIGIT = re.compile(r"\d")
_FORMAT = regex.compile(r"\p{Cf}+")
_PARTS = re.compile(r"[\s,;|]+")
_CLAUSE = re.compile(r"[;:；：]")
_BULLET = re.compile(r"[-+*•→–—·=▪◦‣:]+")
_FORM = re.compile(r"[a-z][0-9]|[0-9][a-z]|\w=\S|\d\d:\d\d:\d\d|[\w.]/[\w./]", re.I)

#: Statistics that are ranked within a language, each a number for every document that has text.
RANKED = ("n_words", "mean_word", "symbol_ratio", "digit_ratio", "end_share", "common_share", "short_line_share", "odd_word_share", "repeat_share", "compression", "unpunctuated")
#: The statistics whose upper tails speak for a kind. Those of FALLING do so the lower they are; they are ranked negated.
KIND_STATISTICS = {
    "table": ("table_share",), "list": ("list_share",),
    "junk": ("odd_word_share", "top_share", "repeat_share", "form_share", "markup_share", "single_share", "unpunctuated", "letters"),
}
FALLING = ("letters",)
SPEAKING = tuple(x for xs in KIND_STATISTICS.values() for x in xs if x not in RANKED)
#: A candidate of a kind is rarer than this: no more than half of its language is as extreme.
EXTREME = math.log(2)
FIELDS = (*RANKED, "list_share", "table_share", "markup_share", "form_share", "single_share", "top_share", "n_lines", "letters")
STATS = "doc_id bigint, language string, " + ", ".join(f"{f} double" for f in FIELDS)


def _cells(line: str, sep: str) -> int:
    if sep == "  ":
        return len(re.split(r"\s{2,}", line.strip())) if "  " in line or "\t" in line or not line.isascii() else 1
    if sep == "|":
        return line.strip().strip("|").count("|") + 1 if "|" in line else 1
    return line.count(sep) + 1


def table_share(lines: list[str]) -> float:
    """Share of the lines that are rows of several cells, as many in most rows, by the separator that gives most."""
    rows = [x for x in lines if not _RULE.match(x)]
    ruled = len(lines) - len(rows)
    if len(rows) < 2:
        return 0.0
    best = 0.0
    for sep in ("\t", "|", ";", ",", "  "):
        if not any(("  " in x or "\t" in x or not x.isascii()) if sep == "  " else sep in x for x in rows):
            continue
        counts = [_cells(x, sep) for x in rows]
        many = Counter(c for c in counts if c > 1)
        if not many:
            continue
        cells, hits = many.most_common(1)[0]
        if sep in ",;" and cells == 2 and hits < len(rows) - 1:
            continue
        if sep in (",", ";", "  "):  # a row's cells are a few words each, and it does not end as a sentence
            slack = 2 if sep == "  " else 0
            hits = sum(1 for x, c in zip(rows, counts) if 1 < c <= 16 and abs(c - cells) <= slack and not _ENDS.search(x) and max(len(y.split()) for y in (re.split(r"\s{2,}", x) if slack else x.split(sep))) <= 4)
        if hits >= 2:
            best = max(best, (hits + ruled) / len(lines))
    return best


def list_share(lines: list[str]) -> float:
    """Share of the lines that are separate entries: marked ones, or short ones without a sentence's end."""
    if len(lines) < 3:
        return 0.0
    marked = sum(1 for x in lines if _MARK.match(x))
    if marked >= 0.6 * len(lines):
        return (marked + sum(1 for x in lines if not _MARK.match(x) and len(x) <= 50 and not _ENDS.search(x))) / len(lines)
    entries = 0
    for x in lines:
        words = len(x.split())
        size = len(_CJK.findall(x)) / 2 + words
        if _MARK.match(x) or size <= 9 and len(x) <= 60 and not re.search(r"[.!?…。！？](?:\s|$|[”»“」\"])", x) and not x.endswith((",", "，", "-")):
            entries += 1
    return entries / len(lines)


def _coded(token: str) -> bool:
    """Whether a token is a code: letters and digits mixed, a time, a path, an assignment."""
    return bool(_FORM.search(token))


def _odd(token: str) -> bool:
    """Whether a token is no word, number or usual sign: signs inside, consonants only, or too long for any word."""
    core = token.strip(".,;:!?\"'“”’‘«»„()[]…—–-*_|>#。，、！？「」")
    if not core:
        return len(token) > 1 or token in "~^\\|{}_=+<>@#$%&*"
    if _CJK.search(core) or core.replace(".", "").replace(",", "").replace(":", "").isdigit():
        return False
    if len(core) > 40 and not re.search(r"[-/.–—]\w+[-/.–—]", core):
        return True
    inner = any(not (c.isalpha() or c in "'’-.&/,") for c in core)
    if inner and not core[-1:].isdigit() and not re.match(r"[£$€]?[\d.,]+\w{0,2}$", core):
        return True
    plain = re.sub(r"[^a-zA-Z]", "", core)
    return len(plain) >= 4 and plain == core and not re.search(r"[aeiouyAEIOUY]", plain) or len(plain) >= 5 and bool(re.search(r"[bcdfghjklmnpqrstvwxz]{6,}", plain.lower()))


class Token(NamedTuple):
    """What a text's statistics need of one of its tokens, the runs of other signs than white space."""

    words: tuple[str, ...]
    letters: int
    digits: int
    coded: bool
    parts: int
    parts_size: int
    odd: int
    single: int


def _token(token: str) -> Token:
    words = _WORD.findall(token)
    parts = [x for x in _PARTS.split(token) if x and not _BULLET.fullmatch(x)]
    return Token(
        tuple(w.lower() for w in words), sum(map(len, words)), 0 if token.isalpha() else len(_DIGIT.findall(token)), not token.isalpha() and _coded(token),
        len(parts), sum(map(len, parts)), sum(len(x) for x in parts if _odd(x)), sum(len(x) == 1 and not _CJK.match(x) for x in parts),
    )


_token_kept = lru_cache(maxsize=200_000)(_token)


def _repeats(units: Sequence[str], size: int) -> float:
    """The share of runs of `size` units that occurred before."""
    return 1 - len(set(zip(*(units[i:] for i in range(size))))) / (len(units) - size + 1)


def statistics(text: str, common: dict[str, frozenset[str]]) -> tuple:
    """(language, the numbers of FIELDS) of a text that is not blank."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFC", text).replace("\xa0", " "))
    lines = [x.strip("  　") for x in text.split("\n")]
    lines = [x.strip() if "\t" not in x else x.strip(" ") for x in lines if x.strip()]
    size = sum(map(len, lines)) or 1
    plain = text.isascii()
    tokens = text.split()
    counted = Counter(tokens)
    known = [(_token_kept(t) if len(t) <= 40 else _token(t), len(t), times) for t, times in counted.items()]
    lower: dict[str, int] = {}
    letters = digits = coded = n_parts = whole = odd = single = n_tokens_size = n_words = 0
    for (words, own_letters, own_digits, is_coded, parts, parts_size, own_odd, singles), length, times in known:
        for word in words:
            lower[word] = lower.get(word, 0) + times
        n_words += len(words) * times
        letters += own_letters * times
        n_parts += parts * times
        whole += parts_size * times
        n_tokens_size += length * times
        if own_letters < length:
            digits += own_digits * times
            single += singles * times
            coded += length * times if is_coded else 0
        elif length == 1:
            single += singles * times
        odd += own_odd * times
    units_han = [] if plain else _CJK.findall(text)
    han = len(units_han)
    cyrillic = 0 if plain else len(_CYRILLIC.findall(text))
    if han > 0.2 * letters:
        language, n = "zh", han
        shared = common.get("zh", frozenset())
        hits = sum(c in shared for c in units_han)
    else:
        n = n_words
        counts = {lang: sum(lower[word] for word in shared & lower.keys()) for lang, shared in common.items() if lang != "zh"}
        language = "ru" if cyrillic > 0.4 * letters else max(sorted(counts), key=lambda k: counts[k], default="") if any(counts.values()) else "und"
        hits = counts.get(language, 0)
    seen = max(1, n_tokens_size)
    symbols = seen - digits - letters
    joined = " ".join(tokens)
    encoded = joined.encode("utf-8", "replace")
    packed = len(zlib.compress(encoded, 6)) / max(1, len(encoded))
    top_line = max(Counter(lines).items(), key=lambda x: len(x[0]) * x[1], default=("", 0))
    sentences = Counter(x for x in map(str.strip, _SENTENCE.findall(joined)) if len(x) > 3)
    top_sentence = max(sentences.items(), key=lambda x: len(x[0]) * x[1], default=("", 0))
    top = 0.0
    if top_line[1] > 2:
        top = len(top_line[0]) * top_line[1] / size
    if top_sentence[1] > 2:
        top = max(top, len(top_sentence[0]) * top_sentence[1] / max(1, len(joined)))
    if n_words >= 12:
        word, times = max(lower.items(), key=lambda x: x[1])
        top = max(top, len(word) * times / max(1, letters))
    repeat = _repeats(tokens, 3) if len(tokens) > 10 else 0.0
    if han and len(tokens) < 0.2 * n:
        repeat = _repeats(text, 8) if len(text) > 38 else 0.0
    single = single / max(1, n_parts)
    short = sum(len(x) <= 60 for x in lines) / max(1, len(lines))
    ends = sum(bool(_ENDS.search(x, max(0, len(x) - 60))) for x in lines) / max(1, len(lines))
    longest = 0.0
    for sentence in sentences:
        if len(sentence) / 2 + 1 > longest:  # else it cannot have more words
            for x in _CLAUSE.split(sentence):
                if len(x) / 2 + 1 > longest:
                    longest = max(longest, len(x.split()) + (0 if plain else len(_CJK.findall(x)) / 2))
    values = dict(
        n_words=n, mean_word=letters / max(1, n_words), symbol_ratio=symbols / seen, digit_ratio=digits / seen, end_share=ends, common_share=hits / max(1, n), short_line_share=short,
        odd_word_share=odd / (whole or 1), repeat_share=repeat, compression=packed, unpunctuated=float(longest), list_share=list_share(lines), table_share=table_share(lines),
        markup_share=sum(len(m) for m in _TAG.findall(text)) / max(1, len(text)) if "<" in text or "&" in text else 0.0, form_share=coded / seen, single_share=single, top_share=top, n_lines=float(len(lines)), letters=letters / seen,
    )
    return (language, *(float(values[f]) for f in FIELDS))


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, language and the statistics of each document with text; null, empty and blank texts have no row. Repeated
    deliveries of a doc_id count once. Whole texts are read, of any length. Extra columns are ignored."""
    common: dict[str, set[str]] = {}
    for row in common_words.select("lang", "word").where("lang IS NOT NULL AND word IS NOT NULL").collect():  # a fixed list
        common.setdefault(row.lang, set()).add(row.word.lower())
    frozen = {k: frozenset(v) for k, v in common.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, *statistics(t, frozen)) for i, t in rows.itertuples(index=False) if t and not t.isspace()]
            yield pd.DataFrame(out, columns=["doc_id", "language", *FIELDS])

    return once_by(documents.where("text IS NOT NULL AND text <> ''"), "doc_id", "text").mapInPandas(run, STATS)


def outlier_scores(stats: DataFrame, buckets: int = 16) -> DataFrame:
    """(doc_id, outlier, table_tail, list_tail, junk_tail): surprises of each document, a surprise being -log of an
    empirical tail probability among the documents of its language by exact ranks, or among all where the language cannot
    be told. outlier: the sum over the statistics of RANKED of the smaller tail's. The others: the greatest of the upper
    tails of the statistics that speak for a kind. Ties share a rank; a language of one document has no surprise."""
    group = F.when(F.col("language") == "und", "*").otherwise(F.col("language"))
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("stat"), F.round(-F.col(f) if f in FALLING else F.col(f), 6).alias("value")) for f in (*RANKED, *SPEAKING)])).alias("x")
    long = stats.select("doc_id", group.alias("group"), values).select("doc_id", "group", "x.stat", "x.value")
    counted = long.select("group", "stat", "value").unionByName(long.where("group <> '*'").select(F.lit("*").alias("group"), "stat", "value"))
    ranks = upper_ranks(counted, ["group", "stat"], "value", buckets)
    up, down = -F.log(F.col("n_ge") / F.col("n")), -F.log(F.col("n_le") / F.col("n"))
    scored = ranks.select("group", "stat", "value", up.alias("up"), F.greatest(up, down).alias("either"))
    # a share of nothing is the least there is: its upper tail is everything, its surprise 0, and it need not be looked up
    asked = long.where(F.col("stat").isin(*RANKED, *FALLING) | (F.col("value") != 0))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("stat").isin(*KIND_STATISTICS[kind]), F.col("up"))), F.lit(0.0)).alias(f"{kind}_tail")
    return asked.join(scored, ["group", "stat", "value"]).groupBy("doc_id").agg(F.sum(F.when(F.col("stat").isin(*RANKED), F.col("either"))).alias("outlier"), of("table"), of("list"), of("junk"))


def kinds(stats: DataFrame, outliers: DataFrame) -> DataFrame:
    """Statistics with surprises and kind. The candidates of a kind are the documents that are more extreme than half of
    their language in a statistic that speaks for it; its definition then decides exactly. A candidate is a table or a list
    if nearly all of it is; junk if one thing is most of it, if most of it is markup, codes or signs, or its words are none;
    near those borders it is junk if it is also an outlier of its language."""
    both = stats.join(outliers, "doc_id")
    c = F.col
    candidate = lambda kind: c(f"{kind}_tail") >= EXTREME
    outlying = c("outlier") >= 18.0
    one_thing = (c("top_share") >= 0.5) | (c("repeat_share") >= 0.75) & (c("table_share") < 0.8)
    codes = (c("markup_share") >= 0.4) | (c("form_share") >= 0.35) & (c("table_share") < 0.8)
    garbled = (c("odd_word_share") >= 0.35) | (c("single_share") >= 0.45) & (c("n_words") >= 8)
    no_sentences = (c("letters") < 0.45) | (c("unpunctuated") >= 60) | (c("unpunctuated") >= 40) & (c("n_lines") == 1) & (c("end_share") == 0)
    near_junk = (c("top_share") >= 0.42) | (c("odd_word_share") >= 0.25) | (c("single_share") >= 0.38) & (c("n_words") >= 8) | (c("unpunctuated") >= 48) & (c("n_lines") < 5) | (c("form_share") >= 0.22)
    kind = (
        F.when(candidate("junk") & (one_thing | codes), "junk")
        .when(candidate("table") & (c("table_share") >= 0.8), "table")
        .when(candidate("list") & (c("list_share") >= 0.85) & (c("odd_word_share") < 0.3), "list")
        .when(candidate("junk") & (garbled | no_sentences | near_junk & outlying), "junk")
        .otherwise("prose")
    )
    return both.withColumn("kind", kind)


def document_kinds(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """All statistics, the outlier score and the kind of each document with text."""
    stats = cut(document_statistics(documents, common_words), "statistics")
    return kinds(stats, outlier_scores(stats))
