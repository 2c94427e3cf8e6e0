"""Citations against bibliography and sources: uses and entries, claims and passages, which sources could be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that a block and a sentence of a source must have to be quoted.
BLOCK_WORDS, SENTENCE_WORDS = 8, 5


def uses_with_entries(uses: DataFrame, entries: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """uses with the columns of the entry of their key, and listed: whether there is one. Of entries with one key the last counts.

    Null keys are not listed. uses' rows all stay; entries' columns named like uses' are left out.
    """
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    chosen = entries.withColumn("_last", last).where("_last = 1").select(key, *[c for c in entries.columns if c not in uses.columns and c != key], F.lit(True).alias("_listed"))
    return uses.join(chosen, key, "left").withColumn("listed", F.coalesce("_listed", F.lit(False))).drop("_listed")


def cited_claims(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """A row for each use of a key in a sentence: sentences (doc_id, sentence_id, text) by citations (doc_id, sentence_id, key, in_bibliography); repeated uses stay."""
    inside = citations.where(~F.col("in_bibliography")).select("doc_id", "sentence_id", "key")
    return sentences.select("doc_id", "sentence_id", "text").join(inside, ["doc_id", "sentence_id"])


def with_citation(sentences: DataFrame, citations: DataFrame, cited: bool = True) -> DataFrame:
    """The sentences that have (or have not) a citation."""
    return sentences.join(citations.select("doc_id", "sentence_id"), ["doc_id", "sentence_id"], "left_semi" if cited else "left_anti")


def anchored(findings: DataFrame, sentences: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """findings with the text and place of their span, a sentence's or a paragraph's: span_text, span_start; null for other spans."""
    spans = sentences.select("doc_id", F.col("sentence_id").alias("span_id"), F.col("text").alias("span_text"), F.col("start").alias("span_start"))
    spans = spans.unionByName(paragraphs.select("doc_id", F.col("paragraph_id").alias("span_id"), F.col("text").alias("span_text"), F.col("start").alias("span_start")))
    return findings.join(spans, ["doc_id", "span_id"], "left")


def passages(sentences: DataFrame, *block: str, pos: str = "pos") -> DataFrame:
    """block, pos, n (1 or 2) and text: sentences of SENTENCE_WORDS words, and each sentence with the one after it.

    sentences: (block, pos, text) of blocks; those of fewer than BLOCK_WORDS words give none.
    """
    own = Window.partitionBy(*block)
    size = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = sentences.withColumn("_n", size).withColumn("_all", F.sum("_n").over(own)).where(F.col("_all") >= BLOCK_WORDS)
    rows = rows.withColumn("_next", F.lead("text").over(own.orderBy(pos)))
    single = F.when(F.col("_n") >= SENTENCE_WORDS, F.struct(F.lit(1).alias("n"), F.col("text").alias("text")))
    pair = F.when(F.col("_next").isNotNull(), F.struct(F.lit(2).alias("n"), F.concat_ws(" ", "text", "_next").alias("text")))
    return rows.select(*block, pos, F.explode(F.filter(F.array(single, pair), lambda p: p.isNotNull())).alias("p")).select(*block, pos, "p.n", "p.text")


def source_coverage(attempts: DataFrame, *by: str) -> DataFrame:
    """by, attempted and full_text: different keys that were looked for, and of those the ones read in full."""
    return attempts.groupBy(*by).agg(F.count_distinct("key").alias("attempted"), F.count_distinct(F.when(F.col("is_full_text"), F.col("key"))).alias("full_text"))


def is_boilerplate(text: Column, phrases: list[str]) -> Column:
    """Whether the text, in lower case with single spaces, holds a phrase or is part of one; phrases are in that form."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return reduce(Column.__or__, [flat.contains(p) | F.lit(p).contains(flat) for p in phrases], F.lit(False))


def best_candidate(candidates: DataFrame, *query: str) -> DataFrame:
    """Of each query's candidates (query, ord, score, ...) the one of the best score, the first of equally good ones."""
    cols = [c for c in candidates.columns if c not in query]
    top = F.max_by(F.struct(*cols), F.struct(F.col("score"), -F.col("ord")))
    return candidates.where(F.col("score") > 0).groupBy(*query).agg(top.alias("_b")).select(*query, "_b.*")


def search_union(answers: dict[str, DataFrame]) -> DataFrame:
    """Records of several sources as one table with their source's name, columns that a source lacks being null."""
    frames = [df.withColumn("source", F.lit(name)) for name, df in sorted(answers.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
