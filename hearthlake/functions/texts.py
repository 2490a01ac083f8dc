"""Keyword matching by pairs of letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring letters of ``plain`` text; a text of one letter is its own pair."""
    return F.when(F.length(text) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2)))).when(
        F.length(text) == 1, F.array(text)
    ).otherwise(F.array().cast("array<string>"))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's pairs that the text has."""
    return F.size(F.array_intersect(query, text)) / F.nullif(F.size(query).cast("double"), F.lit(0.0))


def share_within(query: str, text: Column) -> Column:
    """Share of the distinct pairs of a given query that a ``plain`` text of any length has, without making the text's pairs."""
    letters = "".join(c for c in query.lower() if c.isalnum())
    pairs = dict.fromkeys([letters[i : i + 2] for i in range(len(letters) - 1)] or [letters] * bool(letters))
    return sum((F.contains(text, F.lit(p)).cast("int") for p in pairs), F.lit(0)) / F.lit(float(len(pairs))) if pairs else F.lit(None).cast("double")
