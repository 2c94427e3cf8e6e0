"""What edits may rest on and where they may fall: evidence pointers, the gate, and scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The artifacts an edit run needs, in the order in which a failure is told.
REQUIRED = ("fluff", "voice", "novelty", "grounding")
# Titles of sections whose paragraphs are findings; and what a measurement looks like.
FINDINGS_SECTIONS = ("result", "evaluation", "experiment", "finding", "measurement")
MEASUREMENT = r"[0-9]+\.[0-9]+|[0-9]+(?:\.[0-9]+)?\s*%|\bpercent\b"


def fluff_pointer(rule: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("fluff:"), rule, F.lit("@"), start.cast("string"), F.lit("-"), end.cast("string"))


def orphan_pointer(span: Column) -> Column:
    return F.concat(F.lit("novelty:orphan:"), span)


def citation_pointer(key: Column) -> Column:
    return F.concat(F.lit("grounding:citation:"), key)


def claim_pointer(span: Column, key: Column) -> Column:
    return F.concat(F.lit("grounding:claim:"), span, F.lit(":"), key)


def pointers(fluff: DataFrame, orphans: DataFrame, citations: DataFrame, claims: DataFrame) -> DataFrame:
    """(doc_id, pointer) of all that an edit may cite; voice profiles justify none."""
    parts = [
        fluff.select("doc_id", fluff_pointer(F.col("rule"), F.col("start"), F.col("end")).alias("pointer")),
        orphans.select("doc_id", orphan_pointer(F.col("span_id")).alias("pointer")),
        citations.select("doc_id", citation_pointer(F.col("key")).alias("pointer")),
        claims.select("doc_id", claim_pointer(F.col("span_id"), F.col("key")).alias("pointer")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def without_evidence(edits: DataFrame, known: DataFrame) -> DataFrame:
    """Edits (doc_id, evidence) that cite nothing known; must be empty before any is applied."""
    return edits.join(known.withColumnRenamed("pointer", "evidence"), ["doc_id", "evidence"], "left_anti")


def gate(documents: DataFrame, artifacts: DataFrame, series: str) -> DataFrame:
    """doc_id, passed, artifact and reason (missing, stale, version, unconfirmed; the first in REQUIRED's order).

    documents: (doc_id, source_hash); artifacts: (doc_id, name, source_hash, version, confirmed), one a name.
    """
    wanted = documents.select("doc_id", F.col("source_hash").alias("_now"), F.posexplode(F.array(*[F.lit(n) for n in REQUIRED])).alias("_ord", "name"))
    held = wanted.join(artifacts, ["doc_id", "name"], "left")
    why = (
        F.when(F.col("source_hash").isNull(), "missing")
        .when(F.col("source_hash") != F.col("_now"), "stale")
        .when(F.substring_index("version", ".", 2) != series, "version")
    )
    late = F.when((F.col("name") == "novelty") & ~F.coalesce("confirmed", F.lit(False)), "unconfirmed")
    told = held.select("doc_id", F.when(why.isNotNull(), F.struct(F.col("_ord").alias("o"), "name", why.alias("reason"))).when(late.isNotNull(), F.struct((F.col("_ord") + 100).alias("o"), "name", late.alias("reason"))).alias("f"))
    return told.groupBy("doc_id").agg(F.min("f").alias("f")).select("doc_id", F.col("f").isNull().alias("passed"), F.col("f.name").alias("artifact"), F.col("f.reason").alias("reason"))


def scoped(cuts: DataFrame, sections: DataFrame, paragraphs: DataFrame, floats: DataFrame) -> DataFrame:
    """cuts (doc_id, edit_id, start, end, original) with the rule that refuses them, null if none does.

    cut_into_front_matter; and for cuts of whole paragraphs cut_outside_body_section, cut_reports_a_measurement or
    cut_in_a_findings_section: the first that holds. Ranges meet by document, of which each has few.
    """
    c = cuts.alias("c")
    front = c.join(floats.where("kind = 'front_matter'").alias("f"), (F.col("c.doc_id") == F.col("f.doc_id")) & (F.col("f.start") < F.col("c.end")) & (F.col("c.start") < F.col("f.end")), "left_semi").select("doc_id", "edit_id", F.lit(True).alias("_front"))
    whole = c.join(paragraphs.alias("p"), (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c.start") <= F.col("p.start")) & (F.col("p.end") <= F.col("c.end")), "left_semi").select("doc_id", "edit_id", F.lit(True).alias("_whole"))
    around = c.join(sections.alias("s"), (F.col("c.doc_id") == F.col("s.doc_id")) & (F.col("s.start") <= F.col("c.start")) & (F.col("c.end") <= F.col("s.end")))
    deepest = around.groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.edit_id").alias("edit_id")).agg(F.max_by(F.col("s.title"), F.col("s.level")).alias("_title"))
    rows = cuts.join(front, ["doc_id", "edit_id"], "left").join(whole, ["doc_id", "edit_id"], "left").join(deepest, ["doc_id", "edit_id"], "left")
    finding = reduce(lambda a, b: a | b, (F.lower("_title").contains(n) for n in FINDINGS_SECTIONS))
    rule = (
        F.when(F.col("_front"), "cut_into_front_matter")
        .when(F.col("_whole").isNull(), None)
        .when(F.col("_title").isNull(), "cut_outside_body_section")
        .when(F.col("original").rlike(MEASUREMENT), "cut_reports_a_measurement")
        .when(finding, "cut_in_a_findings_section")
    )
    return rows.withColumn("refused_by", rule).drop("_front", "_whole", "_title")
