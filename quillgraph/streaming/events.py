"""Streams of events and of drafts: windowed counts, sessions, and overlap with fixed sources, as Structured Streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import overlap

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of each event type in windows; rows later than `late` are dropped when their window is closed."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counted.select(F.col("w.start").alias("from_ts"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of users: events less than the gap apart."""
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("s.start").alias("from_ts"), "n")


def overlapping_drafts(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """Drafts (doc_id, words) of a stream joined with the shingles (source_id, shingle) of fixed sources, in each micro-batch."""
    return overlap.match(overlap.shingles(drafts, "doc_id"), sources)


def first_of_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
