"""Checks of prose that sums up a run: no percentages, no verdicts, no unknown citations or numbers, no lost caveats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that pass a verdict on a paper.
VERDICTS = (
    "ready for submission",
    "ready to submit",
    "publication ready",
    "ready to publish",
    "in good shape",
    "in great shape",
    "a strong paper",
    "a solid paper",
    "a good paper",
    "a strong contribution",
    "well written",
    "well-written",
    "your paper is good",
    "the paper is good",
    "the paper is strong",
    "the paper is sound",
    "nothing to worry about",
    "no major issues",
    "no major problems",
    "looks great",
    "looks good overall",
    "overall quality",
    "high quality",
)
_PERCENT = r"(?i)[0-9]+(?:\.[0-9]+)?\s*%|\b[0-9]+(?:\.[0-9]+)?\s+per\s?cent\b"


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, list markers at line starts apart."""
    bare = F.regexp_replace(text, r"(?m)^\s*(?:[-*+]\s+|[0-9]+[.)]\s+)", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def cited_keys(text: Column) -> Column:
    """Distinct keys of [1, 2] and `key` marks."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"), F.lit(1))
    numeric = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))
    return F.array_distinct(F.concat(numeric, F.regexp_extract_all(text, F.lit("`([A-Za-z][A-Za-z0-9_.:-]{2,})`"), F.lit(1))))


def violations(analyses: DataFrame) -> DataFrame:
    """doc_id, rule and quote of each breach in analyses (doc_id, text, known_keys, known_numbers: arrays; caveats array).

    A null known_numbers skips the check of numbers. A caveat is lost if the text doesn't contain it, in any case.
    """
    text = F.col("text")

    def rows(name: str, quotes: Column) -> DataFrame:
        return analyses.select("doc_id", F.lit(name).alias("rule"), F.explode(quotes).alias("quote"))

    low = F.lower(text)
    found = [
        rows("percentage", F.regexp_extract_all(text, F.lit(_PERCENT), F.lit(0))),
        rows("citation_not_in_grounding", F.array_except(cited_keys(text), F.col("known_keys"))),
        rows("verdict_on_the_paper", F.array_compact(F.array(*[F.when(low.contains(p), p) for p in VERDICTS]))),
        rows("lost_caveat", F.filter("caveats", lambda c: ~low.contains(F.lower(c)))),
        rows("number_not_in_the_artifacts", F.array_except(numbers(text), F.col("known_numbers"))),
    ]
    return reduce(DataFrame.unionByName, found)
