"""Reading order of pages from placed fragments (page, x, y, right, text): columns, lines, running heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The band of a page's width in which a gutter lies, its least width and the fragments it takes; the distance of
# one line's baselines; the share of a page's height that is margin.
GUTTER_BAND, GUTTER, LEAST_FRAGMENTS, BASELINE, MARGIN_BAND = (0.2, 0.8), 15.0, 6, 1.5, 0.08


def gutters(fragments: DataFrame, width: Column, *page: str) -> DataFrame:
    """page, gap and gutter of pages of two columns: the middle of the widest band that nothing is written in.

    Fragments are swept from left to right; a band begins where all of those before end. Of equally wide ones the left counts.
    """
    sweep = Window.partitionBy(*page).orderBy("x", "right")
    rows = fragments.withColumn("_reach", F.max("right").over(sweep.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.count("*").over(Window.partitionBy(*page)))
    rows = rows.withColumn("_gap", F.col("x") - F.col("_reach")).withColumn("_mid", (F.col("x") + F.col("_reach")) / 2).withColumn("_w", width)
    inside = (F.col("_mid") >= F.col("_w") * GUTTER_BAND[0]) & (F.col("_mid") <= F.col("_w") * GUTTER_BAND[1])
    wide = rows.where((F.col("_n") >= LEAST_FRAGMENTS) & (F.col("_gap") >= GUTTER) & inside)
    return wide.groupBy(*page).agg(F.max("_gap").alias("gap"), F.min_by("_mid", F.struct(-F.col("_gap"), F.col("_mid"))).alias("gutter"))


def baselines(fragments: DataFrame, order: str, *page: str) -> DataFrame:
    """fragments with line (from 0): a fragment joins a line if it lies within BASELINE of the line's first one.

    That depends on the lines before, so it is a fold over a page's fragments in order, whose number a page bounds.
    """
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("line"), F.from_json(F.lit("[]"), "array<struct<o:bigint,line:int>>").alias("out"))

    def step(a: Column, f: Column) -> Column:
        same = F.coalesce(F.abs(f["y"] - a["y"]) <= BASELINE, F.lit(False))
        line = F.when(same, a["line"]).otherwise(a["line"] + 1)
        return F.struct(F.when(same, a["y"]).otherwise(f["y"]).alias("y"), line.alias("line"), F.concat(a["out"], F.array(F.struct(f["o"].alias("o"), line.alias("line")))).alias("out"))

    placed = F.aggregate(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col("y").cast("double").alias("y")))), start, step)["out"]
    lines = fragments.groupBy(*page).agg(placed.alias("_l")).select(*page, F.explode("_l").alias("l")).select(*page, F.col("l.o").alias(order), F.col("l.line").alias("line"))
    return fragments.withColumn(order, F.col(order).cast("long")).join(lines, [*page, order])


def masked(text: Column) -> Column:
    """The trimmed text with its numbers as #."""
    return F.regexp_replace(F.trim(text), r"\d+", "#")


def running_lines(margin: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, key and pages of margin lines (doc, page, text) that stand on more than one page, whatever their numbers."""
    return margin.select(doc, page, masked(F.col("text")).alias("key")).distinct().groupBy(doc, "key").agg(F.count("*").alias("pages")).where("pages > 1")


def in_margin(y: Column, height: Column) -> Column:
    return (y > height * (1 - MARGIN_BAND)) | (y < height * MARGIN_BAND)


def without_running(fragments: DataFrame, height: Column, doc: str, page: str) -> DataFrame:
    """fragments less the running heads and feet."""
    edge = in_margin(F.col("y"), height)
    repeated = running_lines(fragments.where(edge), doc, page).select(doc, F.col("key").alias("_key"))
    keyed = fragments.withColumn("_key", F.when(edge, masked(F.col("text"))))
    return keyed.join(repeated, [doc, "_key"], "left_anti").drop("_key").select(*fragments.columns)


def dehyphenated(text: Column) -> Column:
    """Words cut at line ends put together, where a small letter goes on."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")
