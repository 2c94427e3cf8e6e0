"""Edits: overlaps, splicing, differences, decisions."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_overlaps(edits: list[tuple]) -> set:
    """Ids of the (id, start, end, confidence) that are kept: the most confident first, then the earliest range, then the id; none overlaps another."""
    from bisect import bisect_left, insort

    kept: list[tuple] = []
    ids = set()
    for name, start, end, _ in sorted(edits, key=lambda e: (-e[3], e[1], e[2], e[0])):
        at = bisect_left(kept, (start, end))
        before, after = kept[at - 1] if at else None, kept[at] if at < len(kept) else None
        if (before and before[1] > start) or (after and after[0] < end):
            continue
        insort(kept, (start, end))
        ids.add(name)
    return ids


def splice(text: Column, edits: Column) -> Column:
    """The text with edits (array of struct start, end, proposed; not overlapping) put in, from the last to the first."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["proposed"], F.substring(t, e["end"] + 1, F.length(t))))


def unified_diff(before: str, after: str, name: str = "draft") -> str:
    """A unified diff of two texts by lines."""
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{name}", f"b/{name}"))


def words_delta(edits: DataFrame, *keys: str) -> DataFrame:
    """Words that the edits (original, proposed) add less those they take, for each key."""

    def n(c: str) -> Column:
        return F.size(F.regexp_extract_all(F.col(c), F.lit(r"\S+"), F.lit(0)))

    return edits.groupBy(*keys).agg(F.sum(n("proposed") - n("original")).alias("words_delta"))


def pending(edits: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edits whose id was not rejected; the latest decision (id, decision, at) of an id counts."""
    last = decisions.groupBy("id").agg(F.max_by("decision", "at").alias("decision")).where("decision = 'rejected'")
    return edits.join(last, "id", "left_anti")


def reason(note: Column, fallback: Column, limit: int = 160) -> Column:
    """The note on one line of at most `limit` characters."""
    line = F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), r"\s+", " "))
    return F.substring(F.when(line == "", fallback).otherwise(line), 1, limit)
