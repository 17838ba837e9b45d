"""Scalar text functions as columns, and the same as DuckDB SQL for the queries' checks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode sees it; the regular expressions' own class knows ASCII only.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUOTE = "[\"'“”‘’]"
# Titles dropped before names in relations, pronouns that are no entities, and the entity labels kept.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "sir", "lady", "lord")
PRONOUNS = ("he", "she", "it", "they", "we", "i", "you", "this", "that")
ENTITY_LABELS = ("PERSON", "ORG", "GPE", "LOC", "FAC", "NORP", "EVENT")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"{SPACE}+", " ")


def nfkc(text: Column) -> Column:
    """Compatibility normal form. ASCII texts, which cannot change, skip the Python step's result."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def clean_text(text: Column, normalise: bool = True) -> Column:
    """NFKC, runs of blanks and tabs to one blank, three or more line ends to two, outer white space off."""
    text = nfkc(text) if normalise else text
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def entity_key(text: Column) -> Column:
    """The index side's spelling: lower case, single blanks, outer quotes off."""
    return F.regexp_replace(collapse(F.lower(text)), f"^{QUOTE}+|{QUOTE}+$", "")


def relation_entity_key(text: Column) -> Column:
    """The relation side's spelling: lower case, single blanks, dots off, one leading title off where a name remains."""
    flat = F.regexp_replace(collapse(F.lower(text)), r"\.", "")
    words = F.filter(F.split(flat, f"{SPACE}+"), lambda w: w != "")
    return F.when((F.size(words) >= 2) & words[0].isin(*TITLES), F.array_join(F.slice(words, 2, F.size(words)), " ")).otherwise(flat)


def relation_key(text: Column) -> Column:
    return collapse(F.lower(text))


def is_entity(key: Column) -> Column:
    return (F.length(key) >= 3) & ~key.isin(*PRONOUNS)


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9_-]", "_")


def chunk_key(chunk_id: Column) -> Column:
    """One spelling of chunk ids: with the prefix of leaf nodes."""
    return F.when(chunk_id.startswith("L0_"), chunk_id).otherwise(F.concat(F.lit("L0_"), chunk_id))


def format_options(options: Column) -> Column:
    """'A. first', a line each; null options give an empty text."""
    lines = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda x, i: F.concat(F.chr((i + 65).cast("bigint")), F.lit(". "), F.coalesce(x, F.lit(""))))
    return F.array_join(lines, "\n")


def dense_query(question: Column, options: Column) -> Column:
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\n"), format_options(options))).otherwise(question)


def parse_answer(raw: Column) -> Column:
    """The option letter of a model's answer: at its start, after 'ANSWER:', or standing alone; else Z."""
    flat = F.upper(strip(raw))
    found = lambda pattern: F.nullif(F.regexp_extract(flat, pattern, 1), F.lit(""))
    return F.coalesce(
        found(r"^(?:OPTION\s*)?([A-D])(?:\.|:|\)|$|\s)"),
        found(r"ANSWER\s*:\s*([A-D])"),
        found(r"(?:^|[^\p{L}\p{N}_])([A-D])(?:$|[^\p{L}\p{N}_])"),
        F.lit("Z"),
    )


def truth_text(letter: Column, options: Column, fallback: Column) -> Column:
    """The option that a letter names, else the fallback."""
    return F.coalesce(F.when(letter.rlike("^[A-Z]$"), F.try_element_at(options, F.ascii(letter) - 64)), fallback)


def standardise(text: Column) -> Column:
    return F.upper(strip(text))


def words(text: Column) -> Column:
    """Tokens of the stand-in tokenizer: the text cut at white space."""
    return F.filter(F.split(strip(text), f"{SPACE}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences of the stand-in splitter: cut after . ! ? before white space; blank ones dropped."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda s: s != "")


class Sql:
    """The functions above as DuckDB SQL text."""

    _q = QUOTE.replace("'", "''")

    @staticmethod
    def strip(x: str) -> str:
        return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"

    @staticmethod
    def collapse(x: str) -> str:
        return f"regexp_replace({Sql.strip(x)}, '{SPACE}+', ' ', 'g')"

    @staticmethod
    def entity_key(x: str) -> str:
        return f"regexp_replace({Sql.collapse(f'lower({x})')}, '^{Sql._q}+|{Sql._q}+$', '', 'g')"

    @staticmethod
    def relation_entity_key(x: str) -> str:
        flat = f"replace({Sql.collapse(f'lower({x})')}, '.', '')"
        parts = f"list_filter(regexp_split_to_array({flat}, '{SPACE}+'), lambda w: w <> '')"
        titles = ", ".join(f"'{t}'" for t in TITLES)
        return f"CASE WHEN len({parts}) >= 2 AND {parts}[1] IN ({titles}) THEN array_to_string({parts}[2:], ' ') ELSE {flat} END"

    @staticmethod
    def relation_key(x: str) -> str:
        return Sql.collapse(f"lower({x})")

    @staticmethod
    def is_entity(x: str) -> str:
        pronouns = ", ".join(f"'{p}'" for p in PRONOUNS)
        return f"(length({x}) >= 3 AND {x} NOT IN ({pronouns}))"

    @staticmethod
    def chunk_key(x: str) -> str:
        return f"CASE WHEN starts_with({x}, 'L0_') THEN {x} ELSE 'L0_' || {x} END"

    @staticmethod
    def format_options(x: str) -> str:
        return f"coalesce(array_to_string(list_transform({x}, lambda o, i: chr((64 + i)::INT) || '. ' || coalesce(o, '')), chr(10)), '')"

    @staticmethod
    def dense_query(q: str, x: str) -> str:
        return f"CASE WHEN len({x}) > 0 THEN {q} || chr(10) || {Sql.format_options(x)} ELSE {q} END"

    @staticmethod
    def parse_answer(x: str) -> str:
        flat = f"upper({Sql.strip(x)})"
        found = lambda p: f"nullif(regexp_extract({flat}, '{p}', 1), '')"
        return f"coalesce({found(r'^(?:OPTION\s*)?([A-D])(?:\.|:|\)|$|\s)')}, {found(r'ANSWER\s*:\s*([A-D])')}, {found(r'(?:^|[^\p{L}\p{N}_])([A-D])(?:$|[^\p{L}\p{N}_])')}, 'Z')"

    @staticmethod
    def standardise(x: str) -> str:
        return f"upper({Sql.strip(x)})"

    @staticmethod
    def words(x: str) -> str:
        return f"list_filter(regexp_split_to_array({Sql.strip(x)}, '{SPACE}+'), lambda w: w <> '')"

    @staticmethod
    def sentences(x: str) -> str:
        marked = f"regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
        return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {Sql.strip('s')}), lambda s: s <> '')"
