"""Passages that read machine-written: signals of each paragraph, and whether to fix, review or leave it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.cues import SUPERLATIVES, UNIVERSALS

#: Findings of a filler rule, and hedges in one sentence, from which on they are a signal.
FILLER_RUN, STACKED_HEDGES = 2, 2
#: Sentences of a paragraph and of a document from which rhythm is judged, and the share of the spread that is too even.
RHYTHM_SENTENCES, BASELINE_SENTENCES, UNIFORM_SHARE = 4, 10, 0.5
#: Sections from which on deviation is judged, and how many spreads it takes.
DEVIATION_SECTIONS, DEVIATION_SPREADS = 3, 2.0
# Universals and superlatives of ordinary use.
ORDINARY = ("first", "only", "all", "any", "no", "none", "every", "exact")
# Names with which method sections begin.
METHOD_TITLES = ("method", "methods", "methodology", "materials", "procedure", "experimental setup", "implementation", "setup", "protocol", "apparatus")


def assertive() -> tuple[str, ...]:
    return tuple(w for w in dict.fromkeys((*UNIVERSALS, *SUPERLATIVES)) if w not in ORDINARY)


def is_method(title: Column) -> Column:
    """Whether the title, without leading numbers, begins with a method section's name."""
    bare = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"^[\s0-9.IVXivx]*[.)]?\s+", ""))
    return reduce(lambda a, b: a | b, (bare.startswith(n) for n in METHOD_TITLES))


def rhythm(sentences: DataFrame, doc: str, paragraph: str) -> DataFrame:
    """doc, paragraph, n, spread and is_uniform from sentences (doc, paragraph, words): too even against the document."""
    base = sentences.groupBy(doc).agg(F.when(F.count("*") >= BASELINE_SENTENCES, F.stddev_pop("words")).alias("_base"))
    per = sentences.groupBy(doc, paragraph).agg(F.count("*").alias("n"), F.stddev_pop("words").alias("spread"))
    even = (F.col("n") >= RHYTHM_SENTENCES) & (F.col("spread") < UNIFORM_SHARE * F.col("_base"))
    return per.join(base, doc).withColumn("is_uniform", F.coalesce(even, F.lit(False))).drop("_base")


def signals(findings: DataFrame, doc: str, paragraph: str) -> DataFrame:
    """doc, paragraph, signal and weight from findings (doc, paragraph, sentence, family)."""
    filler = findings.where("family in ('filler_opener', 'throat_clearing')").groupBy(doc, paragraph).agg(F.count("*").alias("weight")).where(F.col("weight") >= FILLER_RUN)
    stacks = findings.where("family = 'hedge_stack'").groupBy(doc, paragraph, "sentence").agg(F.count("*").alias("weight")).where(F.col("weight") >= STACKED_HEDGES)
    stacks = stacks.groupBy(doc, paragraph).agg(F.sum("weight").alias("weight"))
    structural = findings.where("family in ('tricolon', 'balanced_clause', 'section_closing_restatement', 'empty_forward_reference')")
    structural = structural.groupBy(doc, paragraph, F.col("family").alias("signal")).agg(F.count("*").alias("weight"))
    named = [x.withColumn("signal", F.lit(n)).select(doc, paragraph, "signal", "weight") for x, n in ((filler, "filler"), (stacks, "hedge_stack"))]
    return reduce(DataFrame.unionByName, [*named, structural.select(doc, paragraph, "signal", "weight")])


def ungrounded(sentences: DataFrame) -> DataFrame:
    """Sentences (text, cited) that assert strongly without citation or number."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9'-]*"), F.lit(0))
    strong = F.arrays_overlap(words, F.array(*[F.lit(w) for w in assertive()]))
    return sentences.where(strong & ~F.col("cited") & ~F.col("text").rlike("[0-9]"))


def standing(content: Column, texture: Column, fixable: Column) -> Column:
    """fix (content signals with a remedy), review (content signals without), leave (texture alone never flags), or null."""
    return F.when((content > 0) & fixable, "fix").when(content > 0, "review").when(texture > 0, "leave")


def passages(found: DataFrame, rhythms: DataFrame, doc: str, paragraph: str) -> DataFrame:
    """doc, paragraph, causes, content, texture and standing of paragraphs with a signal."""
    content = found.groupBy(doc, paragraph).agg(F.count("*").alias("content"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("causes"), F.bool_or(F.col("signal").isin("filler", "hedge_stack")).alias("_fix"))
    texture = rhythms.where("is_uniform").select(doc, paragraph, F.lit(1).alias("texture"))
    both = content.join(texture, [doc, paragraph], "full_outer").fillna(0, ["content", "texture"]).fillna("", ["causes"]).fillna(False, ["_fix"])
    return both.withColumn("standing", standing(F.col("content"), F.col("texture"), F.col("_fix"))).drop("_fix")


def deviations(profiles: DataFrame, whole: DataFrame, doc: str, measures: list[str], kinds: list[str]) -> DataFrame:
    """doc, section, signal, here and there (text): how a section's voice departs from its document's.

    profiles: (doc, section, *measures, *kinds) of sections, whole: (doc, *measures, *kinds) of documents. A measure departs by
    more than DEVIATION_SPREADS spreads of the document's own sections from the document's value; a kind if it is another one,
    neither is unknown, and the section's is not mixed. Documents of fewer than DEVIATION_SECTIONS sections give none.
    """
    many = Window.partitionBy(doc)
    judged = profiles.withColumns({"_n": F.count("*").over(many), **{f"_s{m}": F.stddev_pop(m).over(many) for m in measures}}).where(F.col("_n") >= DEVIATION_SECTIONS)
    there = whole.select(doc, *[F.col(c).alias(f"_w{c}") for c in (*measures, *kinds)])
    met = judged.join(there, doc)
    found = []
    for m in measures:
        far = (F.col(f"_s{m}") > 0) & (F.abs(F.col(m) - F.col(f"_w{m}")) > DEVIATION_SPREADS * F.col(f"_s{m}"))
        found.append(F.when(far, F.struct(F.lit(f"voice_{m}").alias("signal"), F.round(m, 4).cast("string").alias("here"), F.round(f"_w{m}", 4).cast("string").alias("there"))))
    for k in kinds:
        other = (F.col(k) != F.col(f"_w{k}")) & (F.col(k) != "unknown") & (F.col(f"_w{k}") != "unknown") & (F.col(k) != "mixed")
        found.append(F.when(other, F.struct(F.lit(f"voice_{k}").alias("signal"), F.col(k).alias("here"), F.col(f"_w{k}").alias("there"))))
    rows = met.select(doc, "section", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f"))
    return rows.select(doc, "section", "f.*")
