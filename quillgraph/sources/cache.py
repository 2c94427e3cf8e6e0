"""Stored answers of requests, by a key that equal requests share, with an age limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days that records, searches and full texts stay fresh.
FRESH_DAYS = {"record": 365, "search": 7, "fulltext": 365}


def request_line(method: Column, url: Column) -> Column:
    """METHOD scheme://host/path?query with the host in lower case and parameters in order; the last of equal names counts."""
    base, query = F.split_part(url, F.lit("?"), F.lit(1)), F.split_part(url, F.lit("?"), F.lit(2))
    scheme, rest = F.split_part(base, F.lit("://"), F.lit(1)), F.split_part(base, F.lit("://"), F.lit(2))
    host = F.lower(F.split_part(rest, F.lit("/"), F.lit(1)))
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    names = F.array_distinct(F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1))))
    last = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == n), -1))
    return F.concat(F.upper(method), F.lit(" "), scheme, F.lit("://"), host, path, F.lit("?"), F.array_join(F.array_sort(last), "&"))


def cache_key(line: Column) -> Column:
    return F.substring(F.sha2(line.cast("binary"), 256), 1, 32)


def fresh(cache: DataFrame, now: Column, kind: str) -> DataFrame:
    """Entries (stored_at in seconds) that are young enough."""
    return cache.where((now - F.col("stored_at")) < FRESH_DAYS[kind] * 86_400)


def latest(cache: DataFrame) -> DataFrame:
    """The newest entry of each key."""
    columns = [c for c in cache.columns if c != "cache_key"]
    best = cache.groupBy("cache_key").agg(F.max_by(F.struct(*columns), "stored_at").alias("e"))
    return best.select("cache_key", "e.*")
