"""Lexical and structural rules, with a probe lexicon that occurs in the corpus; sentences are lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.cues import STRUCTURE_STOPWORDS
from quillgraph.operators import rules as op
from quillgraph.operators import stats

from .base import LEXICON_SQL, Query, lexicon, paragraphs, paragraphs_sql, sql_list, table

_OPENERS = ["the", "and", "of", "in", "for", "de", "la", "der", "die"]


def _sentences(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "documents"), "doc_id", *keep).withColumnRenamed("para", "text")


def _hits(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    lex = lexicon(spark).withColumn("section", F.col("rule"))
    return op.phrase_hits(_sentences(spark, sf_dir, *keep), lex, 2, "doc_id", "pos", *keep)


def lexicon_hits_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each phrase in each document."""
    return _hits(spark, sf_dir).groupBy("doc_id", "rule", "phrase").agg(F.count("*").alias("n"))


def lexicon_hits_no_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensifiers and superlatives in sentences without a digit."""
    plain = _sentences(spark, sf_dir).where(~F.col("text").rlike("[0-9]"))
    lex = lexicon(spark).where(F.col("rule").isin("empty_intensifier", "citation_free_superlative")).withColumn("section", F.col("rule"))
    return op.phrase_hits(plain, lex, 2, "doc_id", "pos").groupBy("doc_id", "pos", "phrase").agg(F.count("*").alias("n"))


def repeated_vocabulary_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overused words: severity rises with their uses in the document."""
    hits = op.repeated_severity(_hits(spark, sf_dir).where("rule = 'model_vocabulary'"), "doc_id")
    return hits.groupBy("phrase", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def hedge_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and later phrases of each line."""
    return op.stacked(_hits(spark, sf_dir), "doc_id", "pos")


def opener_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three and more paragraphs that open with a listed word."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    rows = _sentences(spark, sf_dir).withColumn("ordinal", F.row_number().over(own) - 1)
    opening = rows.where(F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).isin(*_OPENERS))
    return stats.consecutive_runs(opening, "doc_id", "ordinal", 3)


def template_repeats_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-item lists of documents that hold two or more of them."""
    hits = F.regexp_count("text", F.lit("[A-Za-z][A-Za-z]*, [A-Za-z]+,? and [A-Za-z]+"))
    rows = table(spark, sf_dir, "documents").select("doc_id", hits.alias("n"))
    return rows.where("n >= 2")


def _content(text: F.Column) -> F.Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]*"), F.lit(0))), F.array(*[F.lit(w) for w in STRUCTURE_STOPWORDS]))


def closing_restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose last paragraph has three or more content words, all of them in the first."""
    ends = _sentences(spark, sf_dir).groupBy("doc_id").agg(F.min_by("text", "pos").alias("first"), F.max_by("text", "pos").alias("last"), F.count("*").alias("paragraphs"))
    rows = ends.where("paragraphs > 1").select("doc_id", _content(F.col("last")).alias("c"), _content(F.col("first")).alias("o"))
    return rows.where((F.size("c") >= 3) & (F.size(F.array_except("c", "o")) == 0)).select("doc_id", F.size("c").alias("content_words"))


def forward_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrase of each rule in lines that point to nothing (no digit, no section or figure)."""
    plain = _sentences(spark, sf_dir).where(~F.lower("text").rlike("[0-9]|section|chapter|figure|table"))
    hits = op.phrase_hits(plain, lexicon(spark).withColumn("section", F.col("rule")), 2, "doc_id", "pos")
    return hits.groupBy("doc_id", "pos", "rule").agg(F.min(F.struct("phrase")).alias("p")).groupBy("rule", F.col("p.phrase").alias("phrase")).agg(F.count("*").alias("n"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = _hits(spark, sf_dir).select("doc_id", "pos", "rule", "severity", "phrase")
    lists = template_repeats_per_section(spark, sf_dir).select("doc_id", F.lit(0).alias("pos"), F.lit("tricolon").alias("rule"), F.lit("low").alias("severity"), F.lit("list").alias("phrase"))
    return lexical.unionByName(lists)


def findings_union_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings by rule and severity, the gravest first."""
    counted = _findings(spark, sf_dir).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
    return counted.orderBy(op.rank(F.col("severity")), "rule")


def finding_top_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent rules of each document; ties to the one found first, then by name."""
    per = _findings(spark, sf_dir).groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos", "rule"))
    return per.select("doc_id", "rule", "n", place.alias("place")).where("place <= 3")


def print_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings of each document a page shows (eight at most) and withholds."""
    n = _findings(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", F.least("n", F.lit(8).cast("long")).alias("shown"), F.greatest(F.col("n") - 8, F.lit(0).cast("long")).alias("withheld"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (lexicon_hits_plain, lexicon_hits_no_digit, repeated_vocabulary_severity, hedge_stack, opener_runs, template_repeats_per_section, closing_restatement, forward_reference, findings_union_sorted, finding_top_causes, print_cap)
}
_S = paragraphs_sql("doc_id")
_TOK = r"regexp_extract_all(lower(para), '[\p{L}\p{N}_]+')"
_G = rf"""g as (select doc_id, pos, para, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) as phrase from (select doc_id, pos, para, {_TOK} as w from {_S})),
  h as (select g.doc_id, g.pos, g.para, lex.phrase, rule, severity from g join {LEXICON_SQL} on g.phrase = lex.phrase)"""
_TRI = "len(regexp_extract_all(text, '[A-Za-z][A-Za-z]*, [A-Za-z]+,? and [A-Za-z]+'))"
_F = f"{_G}, f as (select doc_id, pos, rule, severity, phrase from h union all select doc_id, 0, 'tricolon', 'low', 'list' from documents where {_TRI} >= 2)"
_C = f"list_filter(list_distinct(regexp_extract_all(lower(x), '[a-z][a-z''-]*')), lambda w: w not in ({sql_list(list(STRUCTURE_STOPWORDS))}))"
SQL = {
    "lexicon_hits_plain": f"with {_G} select doc_id, rule, phrase, count(*) as n from h group by all",
    "lexicon_hits_no_digit": f"with {_G} select doc_id, pos::int as pos, phrase, count(*) as n from h where not regexp_matches(para, '[0-9]') and rule in ('empty_intensifier', 'citation_free_superlative') group by all",
    "repeated_vocabulary_severity": f"""with {_G}, u as (select *, count(*) over (partition by doc_id, phrase) as uses from h where rule = 'model_vocabulary')
      select phrase, case when uses >= 3 then 'medium' else 'low' end as severity, count(*) as n, count(distinct doc_id) as documents from u group by all""",
    "opener_runs": f"""with r as (select doc_id, para, row_number() over (partition by doc_id order by pos) - 1 as ordinal from {_S}),
      o as (select doc_id, ordinal, ordinal - row_number() over (partition by doc_id order by ordinal) as i from r where lower(regexp_extract(para, '^[A-Za-z]+')) in ({sql_list(_OPENERS)}))
      select doc_id, min(ordinal)::int as first_pos, max(ordinal)::int as last_pos, count(*) as length from o group by doc_id, i having count(*) >= 3""",
    "template_repeats_per_section": f"select doc_id, {_TRI}::int as n from documents where {_TRI} >= 2",
    "closing_restatement": f"""with e as (select doc_id, arg_min(para, pos) as f, arg_max(para, pos) as l, count(*) as n from {_S} group by doc_id),
      c as (select doc_id, {_C.replace("(x)", "(l)")} as c, {_C.replace("(x)", "(f)")} as o from e where n > 1)
      select doc_id, len(c)::int as content_words from c where len(c) >= 3 and len(list_filter(c, lambda w: not list_contains(o, w))) = 0""",
    "forward_reference": f"""with {_G}, p as (select doc_id, pos, rule, min(phrase) as phrase from h where not regexp_matches(lower(para), '[0-9]|section|chapter|figure|table') group by all)
      select rule, phrase, count(*) as n from p group by all""",
    "findings_union_sorted": f"with {_F} select rule, severity, count(*) as n, count(distinct doc_id) as documents from f group by all",
    "finding_top_causes": f"""with {_F}, c as (select doc_id, rule, count(*) as n, min(pos) as first_pos from f group by all)
      select doc_id, rule, n, place from (select *, row_number() over (partition by doc_id order by n desc, first_pos, rule)::int as place from c) where place <= 3""",
    "print_cap": f"with {_F}, c as (select doc_id, count(*) as n from f group by doc_id) select doc_id, least(n, 8)::bigint as shown, greatest(n - 8, 0)::bigint as withheld from c",
}
