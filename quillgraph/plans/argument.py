"""Claims, roles, support and reviewers' questions over corpus text; probe cues stand in where the corpus has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import cues
from quillgraph.operators import argument as op

from .base import Query, paragraphs, paragraphs_sql, sql_list, table

_MARKERS = ("is of the", "that the", "with the", "of the", "der die", "de la")
_DETAILS = {"sample": ("tion of", "ereren"), "split": ("in the and", "und der"), "runs": ("zqx",)}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("para", "text")


def claim_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document with the most explicit probe marker."""
    return op.extract_claims(_lines(spark, sf_dir), "doc_id", _MARKERS).select("doc_id", "claim_pos", F.length("claim").alias("claim_chars"))


def role_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of lines without sections or citations, counted by language."""
    rows = paragraphs(table(spark, sf_dir, "documents"), "lang").withColumn("role", op.role(F.col("para"), F.lit(None).cast("string"), F.lit(False), F.col("para").contains("that")))
    return rows.groupBy("lang", "role").agg(F.count("*").alias("n"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extract_claims(_lines(spark, sf_dir), "doc_id", _MARKERS).select("doc_id", "claim_pos", op.claim_words(F.col("claim")).alias("want"))


def claim_word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a claim's words the document's other lines have, and how many they lack."""
    other = _lines(spark, sf_dir).join(_claims(spark, sf_dir), "doc_id").where("pos <> claim_pos")
    words = other.select("doc_id", F.explode(F.array_intersect("want", op.content_words(F.col("text")))).alias("w")).distinct().groupBy("doc_id").agg(F.count("*").alias("covered"))
    out = _claims(spark, sf_dir).join(words, "doc_id", "left")
    covered = F.coalesce("covered", F.lit(0).cast("long"))
    return out.select("doc_id", covered.alias("covered"), (F.size("want") - covered).alias("unsupported"))


def orphan_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share no word with their document's claim, by document."""
    rows = _lines(spark, sf_dir).join(_claims(spark, sf_dir), "doc_id").where("pos <> claim_pos")
    alone = rows.where(F.size(F.array_intersect("want", op.content_words(F.col("text")))) == 0)
    return alone.groupBy("doc_id").agg(F.count("*").alias("orphans"), F.min("pos").alias("first_pos"))


def reviewer_missing_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each language nowhere mention a detail."""
    rows = op.missing_details(table(spark, sf_dir, "documents").select("lang", "text"), "text", _DETAILS)
    return rows.groupBy("lang", "detail").agg(F.count("*").alias("n"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def claim_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user turn, the answer of its conversation that covers most of its words; ties to the first."""
    t = _turns(spark, sf_dir)
    asked = t.where("role = 'user'").select("conv_id", "turn", op.support_words(F.col("text")).alias("want"))
    answers = t.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"), op.support_words(F.col("text")).alias("have"))
    scored = asked.join(answers, "conv_id").withColumn("score", F.round(op.coverage(F.col("want"), F.col("have")), 6))
    best = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "answer"))
    return scored.withColumn("b", best).where("b = 1").select("conv_id", "turn", "answer", "score")


def strength_markers_unmet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength markers of user turns that no answer of the conversation has."""
    t = _turns(spark, sf_dir).select("conv_id", "role", F.explode(op.strength_markers(F.col("text"))).alias("marker"))
    asked, given = (t.where(F.col("role") == r).select("conv_id", "marker").distinct() for r in ("user", "assistant"))
    return asked.join(given, ["conv_id", "marker"], "left_anti").groupBy("conv_id").agg(F.count("*").alias("unmet"), F.min("marker").alias("first_marker"))


def support_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of best passages, counted."""
    best = claim_best_passage(spark, sf_dir)
    verdict = op.support_verdict(F.col("score"), F.array().cast("array<string>"), F.lit(False), F.lit("full_text"))
    return best.groupBy(verdict.alias("support")).agg(F.count("*").alias("n"))


def quote_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty words of each long answer that carry most of the question before it."""
    t = _turns(spark, sf_dir)
    asked = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), op.support_words(F.col("text")).alias("want"))
    return t.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select("conv_id", "turn", op.quote_window(F.col("text"), F.col("want")).alias("quote"))


def reviewer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that lines raise, counted."""
    rows = op.questions(_lines(spark, sf_dir).withColumn("cited", F.col("text").rlike(r"\[[0-9]+\]")))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (claim_extract, role_assign, claim_word_coverage, orphan_paragraphs, reviewer_missing_details, claim_best_passage, strength_markers_unmet, support_verdicts, quote_windows, reviewer_questions)
}


def _any(text: str, phrases) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{p}')" for p in phrases) + ")"


def _words(text: str, pattern: str, without) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '{pattern}')), lambda w: w not in ({sql_list(list(without))}))"


_P = "[a-z][a-z0-9''-]*"
_BARE = r"regexp_replace(text, '\[[^\]]{1,60}\]', ' ', 'g')"
_LINES = f"ln as (select doc_id, pos, para as text from {paragraphs_sql('doc_id')})"
_CASE = "case " + " ".join(f"when contains(lower(text), '{m}') then {i}" for i, m in enumerate(_MARKERS)) + " end"
_CL = f"{_LINES}, m as (select *, {_CASE} as m from ln), cl as (select doc_id, arg_min(pos, (m, pos)) as claim_pos, arg_min(text, (m, pos)) as claim from m where m is not null group by doc_id)"
_CW = f"{_CL}, cw as (select doc_id, claim_pos, {_words('claim', _P, [*cues.CLAIM_STOPWORDS, *cues.ENUMERATORS, *cues.CLAIM_STRUCTURE])} as want from cl), ow as (select ln.doc_id, pos, want, {_words('text', _P, cues.CLAIM_STOPWORDS)} as have from ln join cw using (doc_id) where pos <> claim_pos)"
_BP = f"""a as (select conv_id, turn, {_words(_BARE, _P, cues.SUPPORT_STOPWORDS)} as want from conversations where role = 'user'),
  b as (select conv_id, turn as answer, {_words(_BARE, _P, cues.SUPPORT_STOPWORDS)} as have from conversations where role = 'assistant'),
  s as (select conv_id, turn, answer, round(case when len(want) = 0 then 0 else len(list_filter(want, lambda w: list_contains(have, w))) / len(want) end, 6) as score from a join b using (conv_id)),
  best as (select conv_id, turn, answer, score from (select *, row_number() over (partition by conv_id, turn order by score desc, answer) as b from s) where b = 1)"""
_STRONG = sql_list(list(dict.fromkeys((*cues.UNIVERSALS, *cues.SUPERLATIVES, *cues.MAGNITUDES))))
SQL = {
    "claim_extract": f"with {_CL} select doc_id, claim_pos::int as claim_pos, length(claim)::int as claim_chars from cl",
    "role_assign": f"""select lang, case when {_any("para", cues.LIMITATION_CUES)} then 'limitation' when {_any("para", cues.CLAIM_MARKERS)} then 'contribution' when {_any("para", cues.METHOD_CUES)} then 'method'
      when {_any("para", cues.EVIDENCE_CUES)} or (regexp_matches(para, '[0-9]') and contains(para, 'that')) then 'evidence' when {_any("para", cues.INTERPRETATION_CUES)} then 'interpretation' else 'orphan' end as role, count(*) as n
      from {paragraphs_sql("lang")} group by all""",
    "claim_word_coverage": f"""with {_CW}, c as (select doc_id, count(distinct w) as covered from (select doc_id, have, unnest(want) as w from ow) where list_contains(have, w) group by doc_id)
      select doc_id, coalesce(covered, 0)::bigint as covered, (len(want) - coalesce(covered, 0))::bigint as unsupported from cw left join c using (doc_id)""",
    "orphan_paragraphs": f"with {_CW} select doc_id, count(*) as orphans, min(pos)::int as first_pos from ow where len(list_filter(want, lambda w: list_contains(have, w))) = 0 group by doc_id",
    "reviewer_missing_details": "select lang, detail, count(*) as n from (" + " union all ".join(f"select lang, '{k}' as detail from documents where not {_any('text', v)}" for k, v in _DETAILS.items()) + ") group by all",
    "claim_best_passage": f"with {_BP} select * from best",
    "strength_markers_unmet": rf"""with w as (select conv_id, role, unnest(list_concat(list_filter(regexp_extract_all(lower({_BARE}), '{_P}'), lambda w: w in ({_STRONG})), regexp_extract_all(lower({_BARE}), '[0-9]+(?:\.[0-9]+)?'))) as marker from conversations),
      a as (select distinct conv_id, marker from w where role = 'user' except select conv_id, marker from w where role = 'assistant')
      select conv_id, count(*) as unmet, min(marker) as first_marker from a group by conv_id""",
    "support_verdicts": f"with {_BP} select case when score >= 0.7 then 'SUPPORTED' when score >= 0.4 then 'PARTIAL' else 'UNSUPPORTED' end as support, count(*) as n from best group by all",
    "reviewer_questions": "select category, count(*) as n from ("
    + " union all ".join(
        f"select '{c}' as category from {paragraphs_sql('doc_id')} where {w}"
        for c, w in (
            ("unquantified_significance", f"{_any('para', cues.SIGNIFICANCE_WORDS)} and not {_any('para', cues.STATISTICAL_EVIDENCE)}"),
            ("missing_baseline", f"{_any('para', cues.COMPARISON_WORDS)} and not {_any('para', cues.NAMED_COMPARISON)} and not regexp_matches(para, '\\[[0-9]+\\]')"),
            ("generalization_overreach", _any("para", cues.GENERALIZATION_WORDS)),
        )
    )
    + ") group by all",
}
