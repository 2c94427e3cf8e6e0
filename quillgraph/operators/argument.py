"""Contribution claims, roles, support by sources, and what reviewers ask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import cues

CLAIM_OVERLAP = 0.34
SUPPORT, PARTIAL, QUOTE_WORDS = 0.70, 0.40, 60


def has_cue(text: Column, phrases) -> Column:
    """Whether the lower-cased text contains one of the phrases, also inside words."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(p) for p in phrases))


def first_cue(text: Column, phrases) -> Column:
    """The place (from 0) in the list of the first phrase that the text contains; null for none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(p), F.lit(i)) for i, p in enumerate(phrases)])


def _set(text: Column, pattern: str, without) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))), F.array(*[F.lit(w) for w in without]))


def content_words(text: Column) -> Column:
    return _set(text, "[a-z][a-z0-9'-]*", cues.CLAIM_STOPWORDS)


def claim_words(text: Column) -> Column:
    """Content words of a claim less those that only mark or describe it."""
    return _set(text, "[a-z][a-z0-9'-]*", [*cues.CLAIM_STOPWORDS, *cues.ENUMERATORS, *cues.CLAIM_STRUCTURE])


def extract_claims(sentences: DataFrame, doc: str, markers=cues.CLAIM_MARKERS) -> DataFrame:
    """doc, claim_pos and claim: the first sentence (doc, pos, text) with the most explicit marker."""
    found = sentences.withColumn("_m", first_cue(F.col("text"), markers)).where("_m is not null")
    return found.groupBy(doc).agg(F.min_by(F.struct("pos", "text"), F.struct("_m", "pos")).alias("c")).select(doc, F.col("c.pos").alias("claim_pos"), F.col("c.text").alias("claim"))


def role(text: Column, title: Column, cited: Column, shared: Column) -> Column:
    """limitation, contribution, background, method, evidence, interpretation or orphan: the first that fits."""
    title = F.coalesce(F.lower(title), F.lit(""))

    def among(names) -> Column:
        return reduce(lambda a, b: a | b, (title.contains(n) for n in names))

    return (
        F.when(among(cues.LIMITATION_SECTIONS) | has_cue(text, cues.LIMITATION_CUES), "limitation")
        .when(has_cue(text, cues.CLAIM_MARKERS), "contribution")
        .when(cited, "background")
        .when(among(cues.BACKGROUND_SECTIONS) & shared, "background")
        .when(has_cue(text, cues.METHOD_CUES), "method")
        .when(has_cue(text, cues.EVIDENCE_CUES) | (text.rlike("[0-9]") & shared), "evidence")
        .when(has_cue(text, cues.INTERPRETATION_CUES), "interpretation")
        .otherwise("orphan")
    )


def novelty(sentences: DataFrame, doc: str) -> DataFrame:
    """sentences (doc, pos, text, title, cited) with claim_pos, shared (claim words), role and is_evidence; documents without a claim go."""
    claims = extract_claims(sentences.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower("title"), F.lit("abstract")).contains(n) for n in cues.CLAIM_SECTIONS))), doc)
    held = sentences.join(claims.withColumn("_want", claim_words(F.col("claim"))), doc)
    shared = F.array_sort(F.array_intersect("_want", content_words(F.col("text"))))
    held = held.withColumn("shared", shared)
    named = F.when(F.col("pos") == F.col("claim_pos"), "contribution").otherwise(role(F.col("text"), F.col("title"), F.col("cited"), F.size("shared") > 0))
    share = F.size("shared") / F.greatest(F.size("_want"), F.lit(1))
    return held.withColumn("role", named).withColumn("is_evidence", F.col("role").isin("evidence", "method") & (share >= CLAIM_OVERLAP)).drop("_want")


def support_words(text: Column) -> Column:
    """Content words after citation markers are taken out."""
    return _set(F.regexp_replace(text, r"\[[^\]]{1,60}\]", " "), "[a-z][a-z0-9'-]*", cues.SUPPORT_STOPWORDS)


def strength_markers(text: Column) -> Column:
    """Universals, superlatives, magnitudes and numbers: what a passage on the topic alone does not carry."""
    low = F.lower(F.regexp_replace(text, r"\[[^\]]{1,60}\]", " "))
    strong = F.array(*[F.lit(w) for w in dict.fromkeys((*cues.UNIVERSALS, *cues.SUPERLATIVES, *cues.MAGNITUDES))])
    found = F.regexp_extract_all(low, F.lit("[a-z][a-z0-9'-]*"), F.lit(0))
    return F.array_union(F.array_intersect(found, strong), F.regexp_extract_all(low, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def coverage(claim: Column, passage: Column) -> Column:
    """The share of the claim's distinct words (arrays) that the passage has; 0 for a claim without words."""
    return F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, passage)) / F.size(claim)).otherwise(F.lit(0.0))


def support_verdict(score: Column, unmet: Column, deferred: Column, kind: Column) -> Column:
    """SUPPORTED, PARTIAL, UNCHECKABLE (no text, or an abstract that is silent) or UNSUPPORTED."""
    return (
        F.when(kind == "none", "UNCHECKABLE")
        .when((score >= SUPPORT) & (F.size(unmet) == 0) & ~deferred, "SUPPORTED")
        .when((score >= PARTIAL) | deferred, "PARTIAL")
        .when(kind == "abstract", "UNCHECKABLE")
        .otherwise("UNSUPPORTED")
    )


def quote_window(passage: Column, wanted: Column, size: int = QUOTE_WORDS, step: int = 10) -> Column:
    """The first of the passage's windows of `size` words, every `step` words, with most wanted words; short passages whole."""
    w = F.split(F.trim(F.regexp_replace(passage, r"\s+", " ")), " ")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)), F.lit(step))

    def weigh(i: Column) -> Column:
        part = F.array_join(F.slice(w, i + 1, size), " ")
        return F.struct(F.size(F.array_intersect(support_words(part), wanted)).alias("hits"), (-i).alias("neg"), part.alias("part"))

    best = F.array_max(F.transform(starts, weigh))
    cut = F.concat(F.when(best["neg"] == 0, "").otherwise("... "), best["part"], F.when(-best["neg"] + size >= F.size(w), "").otherwise(" ..."))
    return F.when(F.size(w) <= size, passage).otherwise(cut)


def questions(sentences: DataFrame) -> DataFrame:
    """sentences (..., text, cited) with one row for each reviewer's question: category."""
    text = F.col("text")
    asked = F.array_compact(
        F.array(
            F.when(has_cue(text, cues.SIGNIFICANCE_WORDS) & ~has_cue(text, cues.STATISTICAL_EVIDENCE), "unquantified_significance"),
            F.when(has_cue(text, cues.COMPARISON_WORDS) & ~has_cue(text, cues.NAMED_COMPARISON) & ~F.col("cited"), "missing_baseline"),
            F.when(has_cue(text, cues.GENERALIZATION_WORDS), "generalization_overreach"),
        )
    )
    return sentences.withColumn("category", F.explode(asked))


def missing_details(documents: DataFrame, text: str, details=cues.METHOD_DETAILS) -> DataFrame:
    """documents without text, a row for each detail none of whose cues the text contains."""
    missing = F.array_compact(F.array(*[F.when(~has_cue(F.col(text), phrases), name) for name, phrases in details.items()]))
    return documents.withColumn("detail", F.explode(missing)).drop(text)
