import pytest
from pyspark.sql import functions as F

from quillgraph.operators import present
from quillgraph.sources import config


def test_thresholds_and_limits():
    rows = config.parse_thresholds('[a]\nenabled = true\nsource = "definition"\nminimum = 2\n[b]\nenabled = false\n')
    assert rows == [("a", True, "definition", {"minimum": 2.0}), ("b", False, "", {})]
    for bad in ("[a]\nenabled = true\n", "x = 1\n"):
        with pytest.raises(config.ConfigError):
            config.parse_thresholds(bad)
    assert config.parse_limits("[s]\nper_second = 0.2\nburst = 1\n") == [("s", {"per_second": 0.2, "burst": 1.0})]


def test_venues(spark):
    text = "## How this works\nkey: no\n## default\nablation_expected: unknown\n## my_venue\nablation_expected: Required\n"
    profiles = config.venues(spark, text)
    docs = spark.createDataFrame([("a", "My Venue"), ("b", "other"), ("c", None)], "d string, venue string")
    got = {r.d: r.e for r in config.with_venue(docs, profiles).select("d", config.expects(F.col("venue_fields"), "ablation_expected").alias("e")).collect()}
    assert got == {"a": True, "b": False, "c": False}
    with pytest.raises(config.ConfigError):
        config.parse_venues("## only_one\na: b\n")


def test_best_text(spark):
    works = spark.createDataFrame([("a", "abs"), ("b", "abs"), ("c", None), ("d", "abs")], "citation_key string, abstract string")
    html = spark.createDataFrame([("a", "h" * 30), ("b", "h")], "citation_key string, text string")
    pdf = spark.createDataFrame([("a", "p" * 30), ("b", "p" * 30)], "citation_key string, text string")
    got = {r.citation_key: (r.kind, r.text[:1]) for r in config.best_text(works, html, pdf, 20).collect()}
    assert got == {"a": ("full_text", "h"), "b": ("full_text", "p"), "c": ("none", ""), "d": ("abstract", "a")}


def test_pages(spark):
    rows = [("d", f"r{i % 5}", ("low", "high", "medium")[i % 3], i, f"text  {i}") for i in range(12)] + [("e", "r", "low", 0, "x" * 200)]
    df = spark.createDataFrame(rows, "doc string, rule string, severity string, start int, matched_text string")
    got = {r.doc: r for r in present.page(df, "doc").collect()}
    assert (len(got["d"].lines), got["d"].withheld) == (8, 4)
    assert got["d"].lines[0] == "[high] r1: text 1" and got["d"].lines[4].startswith("[medium]")
    assert got["e"].lines[0].endswith("...") and got["e"].withheld == 0
    causes = {r.doc: r.causes for r in present.top_causes(df, "doc").collect()}
    assert causes == {"d": "3 r0, 3 r1, 2 r2 and 2 other", "e": "1 r"}
