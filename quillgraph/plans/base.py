"""What the named queries share: tables, tokens, paragraphs, and the probe lists that occur in corpus text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

# Frequent tokens of the corpus that stand in for a rule pack's phrases: phrase, rule, severity.
PROBE_LEXICON = [
    ("the", "filler_opener", "low"),
    ("of the", "filler_opener", "medium"),
    ("and the", "filler_opener", "high"),
    ("is the", "empty_intensifier", "medium"),
    ("to the", "empty_intensifier", "low"),
    ("in the", "citation_free_superlative", "medium"),
    ("that", "model_vocabulary", "low"),
    ("with", "model_vocabulary", "low"),
    ("de la", "nominalization", "low"),
    ("und der", "nominalization", "medium"),
]
# Words that carry no distinction.
COMMON_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with"]
# Sentence connectives of the corpus.
CONNECTIVES = ["and", "but", "for", "or", "so", "yet", "et", "und", "y"]
# British and American forms.
SPELLINGS = [("colour", "color"), ("analyse", "analyze"), ("behaviour", "behavior"), ("centre", "center"), ("modelling", "modeling"), ("favour", "favor")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: str | Column) -> Column:
    """Runs of [a-z0-9] in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """How many runs of non-blanks the text has."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def paragraphs(df: DataFrame, *keep: str) -> DataFrame:
    """keep, pos (from 0) and para of the \\n-split paragraphs that are not blank; pos counts all lines."""
    split = df.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "para"))
    return split.where(F.col("para").rlike(r"\S"))


def in_list(column: Column, values: list[str]) -> Column:
    return column.isin(*values)


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def lexicon(spark: SparkSession, rows: list[tuple] = PROBE_LEXICON) -> DataFrame:
    """A rule pack as rows: phrase, rule, severity; a fixed list of at most some hundred rows."""
    return spark.createDataFrame(rows, "phrase string, rule string, severity string")


LEXICON_SQL = "(values " + ", ".join(f"('{p}', '{r}', '{s}')" for p, r, s in PROBE_LEXICON) + ") as lex(phrase, rule, severity)"
PARAGRAPHS_SQL = r"""(select * from (select {keep}, unnest(range(len(p))) as pos, unnest(p) as para
  from (select *, string_split(text, chr(10)) as p from documents)) where regexp_matches(para, '\S'))"""


def paragraphs_sql(keep: str) -> str:
    return PARAGRAPHS_SQL.replace("{keep}", keep)
