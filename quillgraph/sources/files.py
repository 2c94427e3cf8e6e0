"""Drafts, pages and artifacts from and to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION_SERIES = "0.1"


def drafts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, source_text and source_hash of whole files; line ends stay as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", F.lit("UTF-8"))
    return files.select(F.sha2(F.col("path").cast("binary"), 256).substr(1, 16).alias("doc_id"), "path", text.alias("source_text"), F.sha2("content", 256).alias("source_hash"))


def html_text(html: Column) -> Column:
    """Readable text of a page: paragraphs between empty lines, scripts, styles, tags and entities gone."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    body = F.regexp_replace(body, r"(?i)<h[1-6][^>]*>|</(p|div|li|ul|ol|tr|table|section|article|h[1-6]|blockquote)>|<br[^>]*>", "\n\n")
    body = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")
    parts = F.transform(F.split(body, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def write_artifact(df: DataFrame, path: str, name: str, source_hash: Column, version: str = VERSION_SERIES + ".0") -> None:
    """Append rows of a pass as an artifact: name, version, source hash and time beside each payload."""
    row = F.struct(*df.columns)
    df.select("doc_id", F.lit(name).alias("name"), F.lit(version).alias("version"), source_hash.alias("source_hash"), F.current_timestamp().alias("created_at"), F.to_json(row).alias("payload")).write.mode("append").partitionBy("name").parquet(path)


def read_artifact(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("name") == name)


def stale(artifacts: DataFrame, current: DataFrame, series: str = VERSION_SERIES) -> DataFrame:
    """artifacts with the reason they can't be used: source_changed, version or missing source; null if they can."""
    now = current.select("doc_id", F.col("source_hash").alias("_now"))
    why = (
        F.when(F.col("_now").isNull(), "no_source")
        .when(F.col("_now") != F.col("source_hash"), "source_changed")
        .when(F.substring_index("version", ".", 2) != series, "version")
    )
    return artifacts.join(now, "doc_id", "left").withColumn("stale", why).drop("_now")
