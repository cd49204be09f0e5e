"""Expressions on questions and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_query(text: Column) -> Column:
    """Lower case, letters, digits and underscores only, single spaces."""
    kept = F.regexp_replace(F.trim(F.lower(text)), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def query_hash(text: Column) -> Column:
    return F.substring(F.sha2(normalize_query(text), 256), 1, 32)


def word_list(text: Column) -> Column:
    """Words between white space; none for blank texts."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def count_of(text: Column, part: str) -> Column:
    """How often a part stands in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def estimate_tokens(text: Column, chars: int = 4) -> Column:
    return F.floor(F.length(text) / chars).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors and vectors of different length."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))
