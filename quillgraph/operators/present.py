"""Findings as pages: the gravest first, no more than fit, with what is withheld counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.rules import rank

#: Findings that a page shows.
SHOWN = 8


def clip(text: Column, limit: int = 80) -> Column:
    """The text on one line, cut to the limit with a mark."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit - 3)), F.lit("..."))).otherwise(line)


def page(findings: DataFrame, doc: str, shown: int = SHOWN) -> DataFrame:
    """doc, lines array<string> and withheld of findings (doc, rule, severity, start, matched_text)."""
    order = Window.partitionBy(doc).orderBy(rank(F.col("severity")), "start", "rule")
    ranked = findings.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy(doc)))
    line = F.concat_ws(" ", F.concat(F.lit("["), "severity", F.lit("]")), F.concat("rule", F.lit(":")), clip(F.col("matched_text")))
    # at most `shown` lines a document
    top = ranked.where(F.col("_n") <= shown).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))).alias("_l"), F.max("_all").alias("_all"))
    return top.select(doc, F.transform("_l", lambda x: x["l"]).alias("lines"), F.greatest(F.col("_all") - shown, F.lit(0)).alias("withheld"))


def top_causes(findings: DataFrame, doc: str, limit: int = 3) -> DataFrame:
    """doc and causes: the most frequent rules with their counts, and how many other rules there are."""
    per = findings.groupBy(doc, "rule").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    order = Window.partitionBy(doc).orderBy(F.desc("n"), "first", "rule")
    ranked = per.withColumn("_p", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy(doc)))
    said = F.array_sort(F.collect_list(F.struct("_p", F.concat_ws(" ", F.col("n").cast("string"), "rule").alias("s"))))
    top = ranked.where(F.col("_p") <= limit).groupBy(doc).agg(said.alias("_s"), F.max("_all").alias("_all"))
    more = F.when(F.col("_all") > limit, F.concat(F.lit(" and "), (F.col("_all") - limit).cast("string"), F.lit(" other"))).otherwise("")
    return top.select(doc, F.concat(F.array_join(F.transform("_s", lambda x: x["s"]), ", "), more).alias("causes"))
