"""Tallies, gaps and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(df: DataFrame, by: str, *keys: str) -> DataFrame:
    """How many rows of each key have each value of `by`. Counts, never shares."""
    return df.groupBy(*keys, by).agg(F.count("*").alias("n"))


def breaches(actual: dict[str, Column], allowed: dict[str, int]) -> Column:
    """The names of limits that are exceeded, as array<string>."""
    return F.array_compact(F.array(*[F.when(actual[k] > allowed[k], k) for k in actual]))


def gaps(present: dict[str, Column]) -> Column:
    """Sentences that name what could not be checked, one for each absent part."""
    return F.array_compact(F.array(*[F.when(~c, F.lit(f"{name} was not checked")) for name, c in present.items()]))


def markdown(title: Column, lines: Column) -> Column:
    """A page of a heading and a list."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("* "), x)), "\n"), F.lit("\n"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
