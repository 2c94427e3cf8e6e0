"""Joins of intervals and points without nested loops: a row goes to each bin that it touches, and bins are joined by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that the half-open interval touches; an empty one touches its start's."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width))


def overlapping(left: DataFrame, right: DataFrame, width: int, keys: list[str] = ()) -> DataFrame:
    """Rows of left (keys, l_start, l_end, ...) and right (keys, r_start, r_end, ...) whose half-open intervals overlap.

    A pair that shares several bins comes out of the first of them. width should be near the usual length: much less makes
    many bins a row, much more puts many rows in a bin.
    """
    a = left.withColumn("_bin", F.explode(bins(F.col("l_start"), F.col("l_end"), width)))
    b = right.withColumn("_bin", F.explode(bins(F.col("r_start"), F.col("r_end"), width)))
    joined = a.join(b, [*keys, "_bin"])
    first = F.floor(F.greatest("l_start", "r_start") / width)
    return joined.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_bin") == first)).drop("_bin")


def containing(points: DataFrame, at: str, ranges: DataFrame, width: int, keys: list[str] = ()) -> DataFrame:
    """Rows of points and ranges (keys, r_start, r_end, ...) with r_start <= at < r_end."""
    a = points.withColumn("_bin", F.floor(F.col(at) / width))
    b = ranges.withColumn("_bin", F.explode(bins(F.col("r_start"), F.col("r_end"), width)))
    return a.join(b, [*keys, "_bin"]).where((F.col(at) >= F.col("r_start")) & (F.col(at) < F.col("r_end"))).drop("_bin")


def merged(df: DataFrame, start: str, end: str, *keys: str) -> DataFrame:
    """keys, start and end of the unions of overlapping or touching intervals; empty intervals are dropped."""
    own = Window.partitionBy(*keys).orderBy(start, end)
    rows = df.where(F.col(end) > F.col(start)).select(*keys, start, end)
    reach = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(own))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with `value` of the last row of right (key, at, value) at or before it, null if there is none.

    Both sides go through one window of each key; rows of right come before rows of left at the same time.
    """
    columns = [c for c in left.columns if c not in (key, at, value)]
    a = left.select(key, at, *columns, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(key, at, *[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in columns], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    own = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(own)
    return a.unionByName(b).withColumn(value, last["_v"]).where(F.col("_side") == 1).drop("_v", "_side")
