"""Statistics of lengths and forms: profiles, runs, habits, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(sorted_values: Column, share: float) -> Column:
    """The value at share * (n - 1), rounded half to even."""
    at = F.bround(F.lit(share) * (F.size(sorted_values) - 1), 0).cast("int")
    return F.element_at(sorted_values, at + 1)


def length_profile(df: DataFrame, n: str, *keys: str) -> DataFrame:
    """paragraphs, mean, population spread and nearest-rank p10 and p90 of n for each key; a key's lengths are one document's."""
    # values come back as (value, count) pairs, so a key holds as many numbers as it has different lengths
    counted = df.groupBy(*keys, n).agg(F.count("*").alias("_c"))
    total = F.sum("_c")
    grouped = counted.groupBy(*keys).agg(total.alias("paragraphs"), F.array_sort(F.collect_list(F.struct(F.col(n).alias("v"), F.col("_c").alias("c")))).alias("_pairs"))
    flat = F.flatten(F.transform("_pairs", lambda p: F.array_repeat(p["v"], p["c"].cast("int"))))
    mean = F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p["v"] * p["c"]) / F.col("paragraphs")
    out = grouped.select(*keys, "paragraphs", mean.alias("_mean"), flat.alias("_all"))
    spread = F.sqrt(F.aggregate("_all", F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))) / F.col("paragraphs"))
    return out.select(*keys, "paragraphs", F.round("_mean", 9).alias("mean"), F.round(spread, 9).alias("spread"), nearest_rank(F.col("_all"), 0.1).alias("p10"), nearest_rank(F.col("_all"), 0.9).alias("p90"))


def shape_runs(df: DataFrame, key: str, pos: str, n: str, tolerance: int, least: int) -> DataFrame:
    """key, first_pos, last_pos and length of runs of rows whose n differs from the one before by at most the tolerance."""
    own = Window.partitionBy(key).orderBy(pos)
    step = F.abs(F.col(n) - F.lag(n).over(own))
    marked = df.withColumn("_new", F.when(step.isNull() | (step > tolerance), 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_new").over(own))
    return runs.groupBy(key, "_run").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_run")


def consecutive_runs(df: DataFrame, key: str, pos: str, least: int) -> DataFrame:
    """key, first_pos, last_pos and length of runs of consecutive distinct positions."""
    rows = df.select(key, pos).distinct()
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return rows.withColumn("_i", island).groupBy(key, "_i").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_i")


def spelling(british: Column, american: Column) -> Column:
    return F.when(british + american == 0, "unknown").when(american == 0, "british").when(british == 0, "american").otherwise("mixed")


def person_counts(text: Column) -> dict[str, Column]:
    """Plural forms in any case, singular ones as written."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ɏ]+"), F.lit(0))
    plural = F.size(F.filter(words, lambda w: F.lower(w).isin("we", "us", "our", "ours")))
    return {"plural": plural, "singular": F.size(F.filter(words, lambda w: w.isin("I", "my", "mine", "me")))}


def person(plural: Column, singular: Column) -> Column:
    return F.when((plural == 0) & (singular == 0), "impersonal").when(plural >= singular, "we").otherwise("i")


def oxford_counts(text: Column) -> dict[str, Column]:
    return {"with_comma": F.regexp_count(text, F.lit(r"[a-zA-Z]+, [a-zA-Z]+, (and|or) ")), "without_comma": F.regexp_count(text, F.lit(r"[a-zA-Z]+, [a-zA-Z]+ (and|or) "))}


def habit(always: Column, never: Column) -> Column:
    return F.when(always + never == 0, "unknown").when(never == 0, "always").when(always == 0, "never").otherwise("mixed")


def exclusive_quantiles(df: DataFrame, x: str, key: str, parts: list[int], of: int = 100) -> DataFrame:
    """key, part, n and x: the exclusive quantile part/of of each key's values.

    The place part * (n + 1) / of lies between two ranks; their values are weighted. Ranks come from one sort by (key, x).
    """
    own = Window.partitionBy(key)
    ranked = df.select(key, F.col(x).alias("_x"), F.row_number().over(own.orderBy(x)).alias("_r"), F.count("*").over(own).alias("n"))
    want = F.explode(F.array(*[F.lit(p) for p in parts])).alias("part")
    spread = ranked.select("*", want)
    place = F.col("part") * (F.col("n") + 1)
    low = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(place / of)))
    near = spread.withColumn("_k", low).withColumn("_d", place - low * of)
    weight = F.when(F.col("n") < 2, 1.0).when(F.col("_r") == F.col("_k"), (of - F.col("_d")) / of).when(F.col("_r") == F.col("_k") + 1, F.col("_d") / of)
    return near.where((F.col("n") < 2) | F.col("_r").isin(F.col("_k"), F.col("_k") + 1)).groupBy(key, "part", "n").agg(F.round(F.sum(F.col("_x") * weight), 6).alias("x"))


def phrase_uses(text: Column, phrases: list[str]) -> Column:
    """How often phrases of whole words occur in the text, in any case, each counted by itself ("would appear" has "appear" too)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    uses = F.lit(0)
    for p in phrases:
        wanted = f" {'  '.join(p.lower().split())} "
        uses = uses + ((F.length(spaced) - F.length(F.replace(spaced, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")
    return uses


def per_hundred(hits: Column, words: Column) -> Column:
    return F.when(words > 0, F.round(100 * hits / words, 2)).otherwise(F.lit(0.0))
