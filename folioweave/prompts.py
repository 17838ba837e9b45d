"""The texts that models are asked with, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = "Summarise the following passages of a book. Keep the people, the events and the details that matter, add nothing that is not there, and stay within about 1000 tokens.\n\nPassages:\n{text}\n\nSummary:"
SUMMARY = "Below are summaries of parts of a book. Merge them into one coherent summary of about 1000 tokens.\n\nSummaries:\n{text}\n\nSummary:"
RELATION = 'List the relations between the given entities that the text states, as a JSON array of objects with the keys "source", "relation" and "target". Use only the given entities. Give [] if there are none.\n\nEntities: {entities}\n\nText:\n{text}'
ANSWER = "Answer the question from the evidence alone. If options are given, reply with the letter of one of them and nothing else.\n\nQuestion: {question}\nEvidence: {evidence}\n\nAnswer:"


def fill(template: str, **values: Column) -> Column:
    """A template with its named places filled; a null value counts as empty. Braces in values stay as they are."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        name = rest[rest.index("{") + 1 : rest.index("}")]
        parts += [F.lit(rest[: rest.index("{")]), F.coalesce(values[name], F.lit(""))]
        rest = rest[rest.index("}") + 1 :]
    return F.concat(*parts, F.lit(rest))


def summary(level: int, text: Column) -> Column:
    """What is asked for a parent of a level: the first is made from passages, the others from summaries."""
    return fill(LEAF if level == 1 else SUMMARY, text=text)


def fill_sql(template: str, **values: str) -> str:
    """`fill` as DuckDB SQL."""
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in values.items():
        text = text.replace("{" + name + "}", f"' || coalesce({value}, '') || '")
    return text
