"""Signals of machine-written passages over the corpus: paragraphs are lines, sentences end at . ! or ?."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import trace as op

from .base import Query, paragraphs, paragraphs_sql, sql_list, table, words


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paragraphs(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "pos", F.explode(F.split("para", r"[.!?]\s+")).alias("text"))
    return rows.withColumn("words", words(F.col("text"))).where("words > 0")


def uniform_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs whose sentences are much more even than the document's."""
    return op.rhythm(_sentences(spark, sf_dir), "doc_id", "pos").where("is_uniform").select("doc_id", "pos", "n")


def ungrounded_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that assert strongly without number or mark, by language."""
    rows = paragraphs(table(spark, sf_dir, "documents"), "lang").select("lang", F.col("para").alias("text"), F.col("para").contains("[").alias("cited"))
    return op.ungrounded(rows).groupBy("lang").agg(F.count("*").alias("n"))


def passage_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings of lines by their signals (the probe lexicon's findings) and rhythm, counted."""
    from .rules import _hits

    found = _hits(spark, sf_dir).select("doc_id", "pos", F.lit(0).alias("sentence"), F.when(F.col("rule") == "filler_opener", "filler_opener").otherwise("hedge_stack").alias("family"))
    rows = op.passages(op.signals(found, "doc_id", "pos"), op.rhythm(_sentences(spark, sf_dir), "doc_id", "pos"), "doc_id", "pos")
    return rows.groupBy("standing", "causes").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (uniform_paragraphs, ungrounded_assertions, passage_standings)}
_S = rf"""(select doc_id, pos, len(regexp_extract_all(s, '\S+')) as words from (select doc_id, pos, unnest(regexp_split_to_array(para, '[.!?]\s+')) as s from {paragraphs_sql("doc_id")}))"""
SQL = {
    "uniform_paragraphs": f"""with s as (select * from {_S} where words > 0), b as (select doc_id, case when count(*) >= 10 then stddev_pop(words) end as base from s group by 1),
      p as (select doc_id, pos, count(*) as n, stddev_pop(words) as spread from s group by all) select doc_id, pos::int as pos, n from p join b using (doc_id) where n >= 4 and spread < 0.5 * base""",
    "ungrounded_assertions": f"""select lang, count(*) as n from {paragraphs_sql("lang")} where len(list_filter(regexp_extract_all(lower(para), '[a-z][a-z0-9''-]*'), lambda w: w in ({sql_list(list(op.assertive()))}))) > 0
      and not contains(para, '[') and not regexp_matches(para, '[0-9]') group by lang""",
}
