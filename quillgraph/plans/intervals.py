"""Intervals, points and as-of joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators import intervals as op

from .base import Query, table

_MS = "(epoch_us(ts) // 1000)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def asof_citation_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase, the user's last click at or before it."""
    e = _events(spark, sf_dir)
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ms").agg(F.max("event_id").alias("click_id"))
    return op.as_of(e.where("event_type = 'purchase'").select("user_id", "ms", "event_id"), clicks, "user_id", "ms", "click_id").select("event_id", "user_id", "click_id")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("day"))


def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer inside the 90 days that begin with another of their orders."""
    o = _orders(spark, sf_dir)
    ranges = o.select("o_custkey", F.col("o_orderkey").alias("opener"), F.col("day").alias("r_start"), (F.col("day") + 90).alias("r_end"))
    found = op.containing(o, "day", ranges, 90, ["o_custkey"]).where("opener <> o_orderkey")
    return found.groupBy("opener").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def deepest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order key, the narrowest of nested key ranges (1000, 100, 10 wide, some missing) that holds it."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    nested = None
    for level, width in ((1, 1000), (2, 100), (3, 10)):
        start = F.floor(F.col("o_orderkey") / width) * width
        part = keys.select(start.cast("long").alias("r_start"), (start + width).cast("long").alias("r_end"), F.lit(level).alias("level")).where((F.col("r_start") / width) % 3 != level % 3).distinct()
        nested = part if nested is None else nested.union(part)
    held = op.containing(keys, "o_orderkey", nested, 1000)
    return held.groupBy("o_orderkey").agg(F.max("level").alias("level"), F.max_by("r_start", "level").alias("r_start"))


def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's spells: half-hours after events, joined where they touch."""
    e = _events(spark, sf_dir).select("user_id", F.col("ms").alias("start"), (F.col("ms") + 1_800_000).alias("end"))
    return op.merged(e, "start", "end", "user_id").select("user_id", F.col("start").alias("from_ms"), F.col("end").alias("to_ms"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's clicks and views whose minutes overlap."""
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ms").alias("l_start"), (F.col("ms") + 60_000).alias("l_end"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ms").alias("r_start"), (F.col("ms") + 60_000).alias("r_end"))
    return op.overlapping(left, right, 60_000, ["user_id"]).select("click_id", "view_id")


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as proposals (confidence: value; range: ten minutes), greedily kept without overlaps."""
    e = _events(spark, sf_dir).where("value is not null")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        from quillgraph.operators.edits import resolve_overlaps

        kept = resolve_overlaps(list(zip(pdf["event_id"], pdf["ms"], pdf["ms"] + 600_000, pdf["value"], strict=True)))
        return pd.DataFrame({"event_id": pdf["event_id"], "user_id": pdf["user_id"], "kept": pdf["event_id"].isin(kept)})

    return e.select("event_id", "user_id", "ms", "value").groupBy("user_id").applyInPandas(resolve, "event_id long, user_id long, kept boolean")


def opener_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events less than half an hour apart."""
    own = Window.partitionBy("user_id").orderBy("ms", "event_id")
    gap = F.col("ms") - F.lag("ms").over(own)
    s = _events(spark, sf_dir).withColumn("new", F.when(gap.isNull() | (gap >= 1_800_000), 1).otherwise(0)).withColumn("session", F.sum("new").over(own))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ms").alias("from_ms"), F.max("ms").alias("to_ms"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (asof_citation_attach, interval_containment, deepest_enclosing, range_merge, overlap_pairs, overlap_resolution, opener_sessions)}
_DAY = "date_diff('day', date '1970-01-01', o_orderdate::date)"
SQL = {
    "asof_citation_attach": """with c as (select user_id, ts, max(event_id) as click_id from events where event_type = 'click' group by all)
      select p.event_id, p.user_id, c.click_id from (select * from events where event_type = 'purchase') p asof left join c on p.user_id = c.user_id and p.ts >= c.ts""",
    "interval_containment": f"""with o as (select o_custkey, o_orderkey, {_DAY} as day from orders)
      select a.o_orderkey as opener, count(*) as n, min(b.o_orderkey) as first_order from o a join o b on a.o_custkey = b.o_custkey and b.day >= a.day and b.day < a.day + 90 and a.o_orderkey <> b.o_orderkey group by all""",
    "deepest_enclosing": """with w as (select * from (values (1, 1000), (2, 100), (3, 10)) t(level, width)),
      r as (select distinct (o_orderkey // width) * width as r_start, width, level from orders, w where (o_orderkey // width) % 3 <> level % 3)
      select o_orderkey, max(level)::int as level, arg_max(r_start, level)::bigint as r_start from orders join r on o_orderkey >= r_start and o_orderkey < r_start + width group by o_orderkey""",
    "range_merge": f"""with m as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from (select user_id, {_MS} as s, {_MS} + 1800000 as e from events)),
      g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as island from m)
      select user_id, min(s) as from_ms, max(e) as to_ms from g group by user_id, island""",
    "overlap_pairs": f"""with e as (select user_id, event_id, event_type, {_MS} as ms from events)
      select c.event_id as click_id, v.event_id as view_id from e c join e v on c.user_id = v.user_id and c.ms < v.ms + 60000 and v.ms < c.ms + 60000 where c.event_type = 'click' and v.event_type = 'view'""",
    "opener_sessions": f"""with e as (select *, ms - lag(ms) over (partition by user_id order by ms, event_id) as gap from (select user_id, event_id, {_MS} as ms from events)),
      s as (select *, sum(case when gap is null or gap >= 1800000 then 1 else 0 end) over (partition by user_id order by ms, event_id rows unbounded preceding) as session from e)
      select user_id, session::bigint as session, count(*) as n, min(ms) as from_ms, max(ms) as to_ms from s group by all""",
}
