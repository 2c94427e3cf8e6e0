"""How authors write: lengths, rhythms, terms, forms. Paragraphs are lines of the corpus; sections are languages or sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators import stats

from .base import CONNECTIVES, SPELLINGS, Query, paragraphs, paragraphs_sql, sql_list, table, tokens, words

_W = r"len(regexp_extract_all(para, '\S+'))"
_PASSIVE = "(?i)(is|are|was|were|be|been) [a-z]+ed"


def _lengths(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "documents"), "doc_id", *keep).withColumn("n", words(F.col("para")))


def para_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, words and characters of each document."""
    return _lengths(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum("n").alias("words"), F.sum(F.length("para")).alias("characters"))


def word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each source, and of each language in it."""
    return _lengths(spark, sf_dir, "source", "lang").groupBy("source", "lang").agg(F.sum("n").alias("words"), F.countDistinct("doc_id").alias("documents"))


def sentence_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, spread and nearest-rank 10th and 90th percentile of each document's paragraph lengths."""
    return stats.length_profile(_lengths(spark, sf_dir), "n", "doc_id")


def doc_rhythm_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of paragraph lengths of each document with at least ten, else null."""
    spread = F.when(F.count("*") >= 10, F.round(F.stddev_pop("n"), 9))
    return _lengths(spark, sf_dir).groupBy("doc_id").agg(spread.alias("baseline"))


def paragraph_spread(spark: SparkSession, sf_dir: str, floor: float = 3.0, least: int = 4) -> DataFrame:
    """Paragraphs of at least `least` sentences whose lengths spread less than the floor."""
    sentences = paragraphs(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "pos", F.explode(F.split("para", r"[.!?]\s+")).alias("s"))
    per = sentences.withColumn("n", words(F.col("s"))).where("n > 0").groupBy("doc_id", "pos").agg(F.count("*").alias("sentences"), F.round(F.stddev_pop("n"), 9).alias("spread"))
    return per.where((F.col("sentences") >= least) & (F.col("spread") < floor))


def paragraph_shape_runs(spark: SparkSession, sf_dir: str, tolerance: int = 5, least: int = 3) -> DataFrame:
    """Runs of paragraphs each about as long as the one before."""
    return stats.shape_runs(_lengths(spark, sf_dir), "doc_id", "pos", "n", tolerance, least)


def profile_by_lang_and_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the corpus, of each language, and of each source in it."""
    rows = _lengths(spark, sf_dir, "source", "lang").groupingSets([[], ["lang"], ["lang", "source"]], "lang", "source")
    return rows.agg(F.grouping_id().cast("int").alias("scope"), F.count("*").alias("paragraphs"), F.sum("n").alias("words"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("spread"))


def section_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language, how far the sources' profiles spread, a row for each measure."""
    per = _lengths(spark, sf_dir, "source", "lang").groupBy("lang", "source").agg(F.avg("n").alias("mean"), F.max("n").alias("longest"))
    spread = per.groupBy("lang").agg(F.round(F.stddev_pop("mean"), 4).alias("mean"), F.round(F.stddev_pop("longest"), 4).alias("longest"))
    return spread.unpivot("lang", ["mean", "longest"], "measure", "spread")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(tokens("text")).alias("pos", "term"))


def term_histogram_topk(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The k most frequent tokens of each language."""
    counted = _terms(spark, sf_dir).groupBy("lang", "term").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    return counted.withColumn("place", place).where(F.col("place") <= k)


def bigram_terms(spark: SparkSession, sf_dir: str, least: int = 50) -> DataFrame:
    """Pairs of neighbouring tokens that occur at least `least` times."""
    w = tokens("text")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    rows = table(spark, sf_dir, "documents").select(w.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("pair"))
    return rows.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def hyphen_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that differ in hyphens only, of which one has some: the most frequent and how many there are."""
    forms = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:-[a-z]+)*"), F.lit(0))).alias("form"))
    counted = forms.groupBy("form").agg(F.count("*").alias("n")).withColumn("key", F.replace("form", F.lit("-"), F.lit("")))
    groups = counted.groupBy("key").agg(F.max_by("form", F.struct("n", "form")).alias("winner"), F.count("*").alias("forms"), F.sum("n").alias("n"), F.bool_or(F.col("form").contains("-")).alias("h"))
    return groups.where("h").drop("h")


def connective_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each connective opens a paragraph."""
    first = paragraphs(table(spark, sf_dir, "documents"), "doc_id").select(F.element_at(F.concat(tokens("para"), F.array(F.lit(""))), 1).alias("word"))
    return first.where(F.col("word").isin(*CONNECTIVES)).groupBy("word").agg(F.count("*").alias("n"))


def spelling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """British and American forms and the verdict for each source."""
    british, american = ([p[k] for p in SPELLINGS] for k in (0, 1))
    t = tokens("text")
    rows = table(spark, sf_dir, "documents").select("source", F.size(F.filter(t, lambda w: w.isin(*british))).alias("b"), F.size(F.filter(t, lambda w: w.isin(*american))).alias("a"))
    return rows.groupBy("source").agg(F.sum("b").alias("british"), F.sum("a").alias("american")).withColumn("spelling", stats.spelling(F.col("british"), F.col("american")))


def person_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-person plural and singular forms of each document, and its person."""
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in stats.person_counts(F.col("text")).items()]).withColumn("person", stats.person(F.col("plural"), F.col("singular")))


def oxford_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with and without a comma before the conjunction, and each source's habit."""
    rows = table(spark, sf_dir, "documents").select("source", *[c.alias(n) for n, c in stats.oxford_counts(F.col("text")).items()])
    return rows.groupBy("source").agg(F.sum("with_comma").alias("with_comma"), F.sum("without_comma").alias("without_comma")).withColumn("habit", stats.habit(F.col("with_comma"), F.col("without_comma")))


def passive_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of paragraphs with a passive form."""
    rows = paragraphs(table(spark, sf_dir, "documents"), "lang")
    return rows.groupBy("lang").agg(F.round(F.avg(F.col("para").rlike(_PASSIVE).cast("int")), 3).alias("ratio"), F.count("*").alias("paragraphs"))


def calibration_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive quantiles (100 parts) of the spreads of documents' paragraph lengths."""
    spreads = _lengths(spark, sf_dir, "lang").groupBy("lang", "doc_id").agg(F.round(F.stddev_pop("n"), 9).alias("x"))
    return stats.exclusive_quantiles(spreads, "x", "lang", [5, 10, 50, 90])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        para_counts,
        word_totals,
        sentence_length_stats,
        doc_rhythm_baseline,
        paragraph_spread,
        paragraph_shape_runs,
        profile_by_lang_and_source,
        section_spreads,
        term_histogram_topk,
        bigram_terms,
        hyphen_variants,
        connective_histogram,
        spelling_pairs,
        person_counts,
        oxford_commas,
        passive_ratio,
        calibration_quantiles,
    )
}
_L = f"(select *, {_W} as n from {paragraphs_sql('doc_id, source, lang')}) as l"
_T = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SQL = {
    "para_counts": f"select doc_id, count(*) as paragraphs, sum(n)::bigint as words, sum(length(para))::bigint as characters from {_L} group by doc_id",
    "word_totals": f"select source, lang, sum(n)::bigint as words, count(distinct doc_id) as documents from {_L} group by all",
    "sentence_length_stats": f"""with s as (select doc_id, list_sort(list(n)) as a, round(avg(n), 9) as mean, round(stddev_pop(n), 9) as spread from {_L} group by doc_id)
      select doc_id, len(a)::bigint as paragraphs, mean, spread, a[round_even(0.1 * (len(a) - 1), 0)::int + 1]::int as p10, a[round_even(0.9 * (len(a) - 1), 0)::int + 1]::int as p90 from s""",
    "doc_rhythm_baseline": f"select doc_id, case when count(*) >= 10 then round(stddev_pop(n), 9) end as baseline from {_L} group by doc_id",
    "paragraph_spread": rf"""with s as (select doc_id, pos, unnest(regexp_split_to_array(para, '[.!?]\s+')) as s from {paragraphs_sql("doc_id")}),
      n as (select doc_id, pos, len(regexp_extract_all(s, '\S+')) as n from s)
      select doc_id, pos::int as pos, count(*) as sentences, round(stddev_pop(n), 9) as spread from n where n > 0 group by doc_id, pos having count(*) >= 4 and round(stddev_pop(n), 9) < 3""",
    "paragraph_shape_runs": f"""with g as (select *, sum(case when d is null or d > 5 then 1 else 0 end) over (partition by doc_id order by pos) as run
      from (select doc_id, pos, n, abs(n - lag(n) over (partition by doc_id order by pos)) as d from {_L}))
      select doc_id, min(pos)::int as first_pos, max(pos)::int as last_pos, count(*) as length from g group by doc_id, run having count(*) >= 3""",
    "profile_by_lang_and_source": f"""select lang, source, (grouping(lang) * 2 + grouping(source))::int as scope, count(*) as paragraphs, sum(n)::bigint as words, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as spread
      from {_L} group by grouping sets ((), (lang), (lang, source))""",
    "section_spreads": f"""with p as (select lang, source, avg(n) as mean, max(n) as longest from {_L} group by all), s as (select lang, round(stddev_pop(mean), 4) as mean, round(stddev_pop(longest), 4) as longest from p group by lang)
      select lang, 'mean' as measure, mean as spread from s union all select lang, 'longest', longest from s""",
    "term_histogram_topk": f"""with c as (select lang, term, count(*) as n from (select lang, unnest({_T}) as term from documents) group by all)
      select * from (select *, row_number() over (partition by lang order by n desc, term)::int as place from c) where place <= 20""",
    "bigram_terms": f"""with p as (select unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) as pair from (select {_T} as w from documents) where len(w) > 1)
      select pair, count(*) as n from p group by pair having count(*) >= 50""",
    "hyphen_variants": """with c as (select form, count(*) as n, replace(form, '-', '') as key from (select unnest(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*')) as form from documents) group by form)
      select key, arg_max(form, (n, form)) as winner, count(*) as forms, sum(n)::bigint as n from c group by key having bool_or(contains(form, '-'))""",
    "connective_histogram": f"""select word, count(*) as n from (select regexp_extract_all(lower(para), '[a-z0-9]+')[1] as word from {paragraphs_sql("doc_id")}) where word in ({sql_list(CONNECTIVES)}) group by word""",
    "spelling_pairs": f"""with c as (select source, sum(len(list_filter({_T}, lambda w: w in ({sql_list([p[0] for p in SPELLINGS])}))))::bigint as british, sum(len(list_filter({_T}, lambda w: w in ({sql_list([p[1] for p in SPELLINGS])}))))::bigint as american from documents group by source)
      select *, case when british + american = 0 then 'unknown' when american = 0 then 'british' when british = 0 then 'american' else 'mixed' end as spelling from c""",
    "person_counts": r"""with c as (select doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ɏ]+'), lambda w: lower(w) in ('we', 'us', 'our', 'ours')))::int as plural, len(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ɏ]+'), lambda w: w in ('I', 'my', 'mine', 'me')))::int as singular from documents)
      select *, case when plural = 0 and singular = 0 then 'impersonal' when plural >= singular then 'we' else 'i' end as person from c""",
    "oxford_commas": r"""with c as (select source, sum(len(regexp_extract_all(text, '[a-zA-Z]+, [a-zA-Z]+, (and|or) ')))::bigint as with_comma, sum(len(regexp_extract_all(text, '[a-zA-Z]+, [a-zA-Z]+ (and|or) ')))::bigint as without_comma from documents group by source)
      select *, case when with_comma + without_comma = 0 then 'unknown' when without_comma = 0 then 'always' when with_comma = 0 then 'never' else 'mixed' end as habit from c""",
    "passive_ratio": f"select lang, round(avg(regexp_matches(para, '{_PASSIVE}')::int), 3) as ratio, count(*) as paragraphs from {paragraphs_sql('lang')} group by lang",
    "calibration_quantiles": f"""with s as (select lang, list_sort(list(x)) as a from (select lang, doc_id, round(stddev_pop(n), 9) as x from {_L} group by all) group by lang),
      q as (select lang, a, len(a) as m, unnest([5, 10, 50, 90]) as part from s),
      j as (select *, greatest(1, least(m - 1, (part * (m + 1)) // 100)) as k from q)
      select lang, part::int as part, m::bigint as n, round(case when m < 2 then a[1] else (a[k] * (100 - (part * (m + 1) - k * 100)) + a[k + 1] * (part * (m + 1) - k * 100)) / 100 end, 6) as x from j""",
}
