"""Vectors as columns: length, unit vectors, products, and the letter-frequency stand-in embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 where one of them is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def letter_vector(text: Column) -> Column:
    """How often each of the 26 letters occurs: a deterministic stand-in for a text embedder."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(lower) - F.length(F.replace(lower, F.lit(c), F.lit("")))).cast("double") for c in ALPHABET])


def letter_vector_sql(text: str) -> str:
    return "[" + ", ".join(f"(length(lower(coalesce({text}, ''))) - length(replace(lower(coalesce({text}, '')), '{c}', '')))::DOUBLE" for c in ALPHABET) + "]"


def dot_sql(a: str, b: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), lambda s, x: s + x)"


def cosine_sql(a: str, b: str) -> str:
    lengths = f"(sqrt({dot_sql(a, a)}) * sqrt({dot_sql(b, b)}))"
    return f"CASE WHEN {lengths} > 0 THEN {dot_sql(a, b)} / {lengths} ELSE 0.0 END"
