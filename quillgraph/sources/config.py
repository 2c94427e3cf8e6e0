"""Rule thresholds, venues and source limits, from their files to rows of small dimension tables."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConfigError(ValueError):
    """A file that must not be used: a rule on without a source, no default venue, no sections."""


def _numbers(section: dict) -> dict[str, float]:
    return {k: float(v) for k, v in section.items() if isinstance(v, int | float) and not isinstance(v, bool)}


def parse_thresholds(text: str) -> list[tuple]:
    """Rows (rule, enabled, source, values) of a TOML file; a rule that is on must name its source."""
    rows = []
    for name, section in tomllib.loads(text).items():
        if isinstance(section, dict):
            source, enabled = str(section.get("source", "")).strip(), bool(section.get("enabled", False))
            if enabled and not source:
                raise ConfigError(f"rule {name} is on without a source")
            rows.append((name, enabled, source, _numbers(section)))
    if not rows:
        raise ConfigError("no rules")
    return rows


def thresholds(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_thresholds(text), "rule string, enabled boolean, source string, `values` map<string,double>")


def parse_limits(text: str) -> list[tuple]:
    """Rows (source, values) of a TOML file of request limits."""
    rows = [(name, _numbers(section)) for name, section in tomllib.loads(text).items() if isinstance(section, dict)]
    if not rows:
        raise ConfigError("no sources")
    return rows


def parse_venues(text: str) -> list[tuple]:
    """Rows (venue, fields): `##` headings like identifiers with `key: value` lines below; `default` must be there."""
    found: dict[str, dict[str, str]] = {}
    fields: dict[str, str] | None = None
    for line in text.splitlines():
        if head := re.match(r"^##\s+(.+?)\s*$", line):
            fields = found.setdefault(head[1], {}) if re.fullmatch(r"[a-z][a-z0-9_]*", head[1]) else None
        elif fields is not None and (pair := re.match(r"^([a-z_]+):\s*(.+?)\s*$", line)):
            fields[pair[1]] = pair[2]
    if "default" not in found:
        raise ConfigError("no default venue")
    return list(found.items())


def venues(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_venues(text), "venue string, fields map<string,string>")


def with_venue(documents: DataFrame, profiles: DataFrame, name: str = "venue") -> DataFrame:
    """documents with venue_fields: those of their venue (case and blanks aside), else the default's."""
    wanted = F.replace(F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))), F.lit(" "), F.lit("_"))
    known = profiles.select(F.col("venue").alias("_v"), F.col("fields").alias("_f"))
    fallback = profiles.where("venue = 'default'").select(F.col("fields").alias("_d"))
    held = documents.withColumn("_w", wanted).join(known, F.col("_w") == F.col("_v"), "left")
    # one row
    return held.join(F.broadcast(fallback)).withColumn("venue_fields", F.coalesce("_f", "_d")).drop("_w", "_v", "_f", "_d")


def expects(fields: Column, key: str) -> Column:
    """Whether the venue asks for it; what isn't known isn't asked for."""
    return F.coalesce(F.lower(fields[key]).isin("yes", "required", "expected"), F.lit(False))


def best_text(works: DataFrame, html: DataFrame, pdf: DataFrame, least: int = 2000) -> DataFrame:
    """works (citation_key, abstract) with kind and text: the first of page text, PDF text (both of `least` characters), abstract, none.

    html and pdf: (citation_key, text), a row for each key at most.
    """
    a, b = (x.select("citation_key", F.when(F.length("text") >= least, F.col("text")).alias(n)) for x, n in ((html, "_h"), (pdf, "_p")))
    held = works.join(a, "citation_key", "left").join(b, "citation_key", "left")
    full = F.coalesce("_h", "_p")
    kind = F.when(full.isNotNull(), "full_text").when(F.length("abstract") > 0, "abstract").otherwise("none")
    return held.withColumn("kind", kind).withColumn("text", F.coalesce(full, "abstract", F.lit(""))).drop("_h", "_p")
