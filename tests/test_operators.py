import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import identity
from quillgraph.operators import argument, edits, ingest, intervals, overlap, report, rules, works
from quillgraph.operators.segment import merge_ranges, sentences
from quillgraph.sources import cache, files, scholarly


def cut(text, protected=()):
    return [text[a:b] for a, b in sentences(text, protected)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("See Fig. 3 and e.g. this. J. Smith et al. agree.", ["See Fig. 3 and e.g. this.", "J. Smith et al. agree."]),
        ("It went on. then stopped. Now.", ["It went on. then stopped.", "Now."]),
        ('He said "Go." Then left.', ['He said "Go."', "Then left."]),
        ("A claim (with. An aside.) ends. Next.", ["A claim (with. An aside.) ends.", "Next."]),
        ("Unbalanced (here. Next one.", ["Unbalanced (here.", "Next one."]),
        ("Let $a. B$ be. So `x. Y` too. End", ["Let $a. B$ be.", "So `x. Y` too.", "End"]),
        ("(The aside ends here.) Next.", ["(The aside ends here.)", "Next."]),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB .!?()[]\"'$`\n"), max_size=60))
def test_sentences_lose_no_prose(text):
    ranges = sentences(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in ranges)
    assert all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    outside = "".join(text[a:b] for a, b in zip([0, *[r[1] for r in ranges]], [*[r[0] for r in ranges], len(text)], strict=True))
    assert not outside.strip()


def test_protected_ranges_hide_sentence_ends():
    text = "At https://x.org/a. B it is. Then."
    assert cut(text, [(3, 21)]) == ["At https://x.org/a. B it is.", "Then."]


def test_citations():
    keys = [k for _, _, k, _ in ingest.find_citations("a [1, 3-5] [@b; -@c] doi:10.1/zz [7](u) https://arxiv.org/abs/2101.00001v2 doi:10.1234/ab.c")]
    assert keys == ["1", "3", "4", "5", "b", "c", "arXiv:2101.00001v2", "10.1234/ab.c"]
    assert ingest.numeric_keys("9-3; 1-200") == ["9-3", "1-200"]


PAPER = """---
title: "On things"
secret: no
---
# Introduction

We show that it works [1]. It rose.

Details
-------
* first. Second.
* other
  goes on

```py
x. y.
```

> quoted. words

| a | b |
|---|---|
| 1 | 2 |

# References

[1] A. Author. A title. 2020.
"""


def test_markdown_entities(spark):
    drafts = spark.createDataFrame([("d", "x/paper.md", PAPER), ("e", "y.md", PAPER.replace("\n", "\r\n")), ("n", "z.txt", None), ("t", "t.TXT", "One. Two.\n\nThree")], "doc_id string, path string, source_text string")
    t = {k: v.orderBy("doc_id", "pos").collect() for k, v in ingest.tables(ingest.entities(drafts)).items()}
    d = {k: [r for r in v if r.doc_id == "d"] for k, v in t.items()}
    assert [(r.title, r.level, r.path) for r in d["sections"]] == [("Introduction", 1, "Introduction"), ("Details", 2, "Introduction > Details"), ("References", 1, "References")]
    assert d["sections"][0].end == PAPER.index("# References")
    assert [r.text for r in d["sentences"]] == ["We show that it works [1].", "It rose.", "first.", "Second.", "other\n  goes on"]
    assert all(PAPER[r.start : r.end] == r.text for r in d["sentences"])
    assert [r.kind for r in d["floats"]] == ["front_matter", "code", "quote", "table", "bibliography"]
    assert [(r.key, r.value) for r in d["metadata"]] == [("title", "On things")]
    assert [r.key for r in d["entries"]] == ["1"]
    assert d["citations"][0].sentence_id == d["sentences"][0].sentence_id
    assert [r.sentence_id for r in t["sentences"] if r.doc_id == "e"][:2] == [r.sentence_id for r in d["sentences"]][:2]
    assert [r.text for r in t["sentences"] if r.doc_id == "t"] == ["One.", "Two.", "Three"]
    with pytest.raises(Exception, match="no parser for .docx"):
        ingest.entities(spark.createDataFrame([("d", "a.docx", "x")], drafts.schema)).collect()


def test_equal_sentences_are_numbered():
    ids = [r["id"] for r in ingest.parse_plain("Same. Same. Same.") if r["entity"] == "sentence"]
    assert ids[1:] == [f"{ids[0]}.1", f"{ids[0]}.2"]


def test_identity():
    assert identity.trim_doi("10.1016/S0140-6736(97)11096-0).") == "10.1016/S0140-6736(97)11096-0"
    assert identity.normal_doi("https://doi.org/10.1/AB.") == "10.1/ab"
    assert identity.normal_arxiv("http://arxiv.org/abs/2101.00001v3") == "2101.00001"
    assert identity.normal_title("RETRACTED: Café, the  Movie!") == "cafe the movie"
    assert [identity.surname(x) for x in ("Smith, Jane", "Jane Smith", " ")] == ["smith", "smith", ""]


def test_merge_ranges_and_frames_agree(spark):
    rng = random.Random(1)
    ranges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]
    got = intervals.merged(spark.createDataFrame([("k", a, b) for a, b in ranges], "k string, s int, e int"), "s", "e", "k").collect()
    assert sorted((r.s, r.e) for r in got) == merge_ranges(ranges)


def test_interval_joins(spark):
    rng = random.Random(2)
    left = [(i, a, a + rng.randrange(0, 40)) for i in range(50) for a in [rng.randrange(300)]]
    right = [(i, a, a + rng.randrange(0, 40)) for i in range(50) for a in [rng.randrange(300)]]
    frames = spark.createDataFrame(left, "l int, l_start int, l_end int"), spark.createDataFrame(right, "r int, r_start int, r_end int")
    got = sorted((x.l, x.r) for x in intervals.overlapping(*frames, 16).collect())
    assert got == sorted((i, j) for i, a, b in left for j, c, d in right if a < d and c < b)
    inside = sorted((x.l, x.r) for x in intervals.containing(frames[0], "l_start", frames[1], 16).collect())
    assert inside == sorted((i, j) for i, a, _ in left for j, c, d in right if c <= a < d)


def test_greedy_runs(spark):
    places = [0, 1, 2, 3, 10, 11, 12, 14, 40, 41, 42, 60]
    got = overlap.greedy_runs(spark.createDataFrame([(1, 2, p) for p in places], "d int, s int, pos int"), "d", "s").collect()
    assert sorted((r.start, r.length) for r in got) == [(0, 11), (40, 10)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8), st.sampled_from([0.3, 0.8, 0.9])), max_size=25))
def test_kept_edits_never_overlap(drawn):
    proposed = [(k, a, a + n, c) for k, (a, n, c) in enumerate(drawn)]
    kept = edits.resolve_overlaps(proposed)
    chosen = sorted((a, b) for k, a, b, _ in proposed if k in kept)
    assert all(x[1] <= y[0] for x, y in zip(chosen, chosen[1:], strict=False))
    for k, a, b, c in proposed:
        if k not in kept:
            assert any(a < q and p < b and conf >= c for j, p, q, conf in proposed if j in kept)


def test_splice_and_decisions(spark):
    row = spark.range(1).select(edits.splice(F.lit("The 😀 quick fox"), F.array(F.struct(F.lit(4).alias("start"), F.lit(5).alias("end"), F.lit("X").alias("proposed")), F.struct(F.lit(12).alias("start"), F.lit(15).alias("end"), F.lit("dog").alias("proposed")))).alias("t")).first()
    assert row.t == "The X quick dog"
    proposed = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    said = spark.createDataFrame([("a", "rejected", 1), ("a", "accepted", 2), ("b", "rejected", 3)], "id string, decision string, at int")
    assert sorted(r.id for r in edits.pending(proposed, said).collect()) == ["a", "c"]
    assert edits.unified_diff("a\nb\n", "a\nc\n").splitlines()[-2:] == ["-b", "+c"]


LEXICON = """# Rules
## Notes
- not a term
## fillers
severity: high
suggestion: delete
- It is noted that
## words
family: model_vocabulary
- utilize -> use
"""


def test_lexicon_and_rules(spark):
    rows = rules.parse_lexicon(LEXICON)
    assert [(r[0], r[2], r[3], r[4], r[7], r[8]) for r in rows] == [("fillers", "fillers", "high", "delete", "It is noted that", None), ("words", "model_vocabulary", "low", "replace_with", "utilize", "use")]
    for bad in ("nothing", "## empty\nseverity: low\n"):
        with pytest.raises(rules.LexiconError):
            rules.parse_lexicon(bad)
    lines = spark.createDataFrame([(1, "It is  noted THAT we utilize it."), (1, "Utilize, utilized; utilize"), (2, "utilize")], "doc int, text string")
    hits = rules.phrase_hits(lines, rules.lexicon_frame(spark, rows), 4, "doc")
    found = sorted((r.doc, r.phrase, r.severity) for r in rules.repeated_severity(hits.where("section = 'words'"), "doc").collect())
    assert found == [(1, "utilize", "medium")] * 3 + [(2, "utilize", "low")]
    assert hits.where("section = 'fillers'").count() == 1


def test_stacked_hits_keep_the_longest(spark):
    rows = [(0, 2, "tends to"), (0, 1, "tends"), (3, 1, "may"), (3, 2, "may be"), (6, 1, "perhaps")]
    hits = spark.createDataFrame([("c", a, n, p, "s") for a, n, p in rows], "clause string, at int, words int, phrase string, section string")
    assert sorted(r.phrase for r in rules.stacked(hits, "clause").collect()) == ["may be", "perhaps"]


def test_novelty_roles(spark):
    rows = [
        (0, "We propose budgeted ranking for archives.", "Introduction", False),
        (1, "Databases are old.", "Introduction", False),
        (2, "Prior work did so.", "Related work", True),
        (3, "Budgeted ranking rose by 3 points.", "Results", False),
        (4, "We did not test archives.", "Results", False),
        (5, "We use an index of archives.", "Method", False),
        (6, "This suggests more.", "Results", False),
    ]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, pos int, text string, title string, cited boolean")
    got = {r.pos: r for r in argument.novelty(df, "doc").collect()}
    assert [got[i].role for i in range(7)] == ["contribution", "orphan", "background", "evidence", "limitation", "method", "interpretation"]
    assert got[3].shared == ["budgeted", "ranking"] and got[3].is_evidence
    assert argument.novelty(df.where("pos > 0"), "doc").count() == 0


def test_support(spark):
    df = spark.createDataFrame([("The index recovers 0.9 of scores at a billion documents [8].", "the index recovers 0.9 of scores", "full_text"), ("Nothing here.", "apples", "abstract"), ("Nothing here.", "apples", "full_text"), ("x", "y", "none")], "c string, p string, kind string")
    claim, passage = argument.support_words(F.col("c")), argument.support_words(F.col("p"))
    unmet = F.array_except(argument.strength_markers(F.col("c")), argument.strength_markers(F.col("p")))
    rows = df.select(argument.support_verdict(argument.coverage(claim, passage), unmet, F.lit(False), F.col("kind")).alias("v"), F.array_sort(unmet).alias("u")).collect()
    assert [r.v for r in rows] == ["PARTIAL", "UNCHECKABLE", "UNSUPPORTED", "UNCHECKABLE"]
    assert rows[0].u == ["billion"]


def test_questions(spark):
    df = spark.createDataFrame([("It is significantly better.", False), ("It outperforms all.", False), ("It outperforms the baseline.", False), ("It always holds, p < 0.01, significantly.", True)], "text string, cited boolean")
    got = [(r.text, r.category) for r in argument.questions(df).collect()]
    assert got == [("It is significantly better.", "unquantified_significance"), ("It outperforms all.", "missing_baseline"), ("It always holds, p < 0.01, significantly.", "generalization_overreach")]


def test_scholarly_sources(spark):
    bodies = {
        "openalex": json.dumps({"results": [{"display_name": "A", "publication_year": 2020, "doi": "https://doi.org/10.1/X", "cited_by_count": 3, "ids": {"arxiv": "abs/2101.00001v2", "mag": None}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "J S"}}, {"author": None}]}]}),
        "crossref": json.dumps({"message": {"items": [{"title": ["RETRACTED: B"], "author": [{"family": "S", "given": "J"}, {"name": "Org"}], "published": {"date-parts": [[2019, 2]]}, "DOI": "10.1/Y", "abstract": "<p>Hi</p>", "updated-by": [{"type": "Retraction", "DOI": "10.1/N", "updated": {"date-parts": [[2021, 3, 4]]}}]}]}}),
        "semantic_scholar": json.dumps({"data": [{"title": "C", "year": 2018, "externalIds": {"DOI": "10.1/Z"}, "publicationTypes": ["Review"], "authors": [{"name": "K L"}]}]}),
        "arxiv": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00002v1</id><title>D  d</title><published>2021-01-01</published><author><name>M N</name></author><link title="pdf" href="u"/></entry></feed>',
    }
    got = {}
    for name, body in bodies.items():
        df = scholarly.READERS[name](spark.createDataFrame([("q", body), ("r", "<not json")], "query_id string, body string"))
        got[name] = df.collect()
        assert len(got[name]) == 1
    a, b, c, d = (got[n][0] for n in bodies)
    assert (a.title, a.authors, a.year, a.doi, a.arxiv_id, a.abstract, a.citation_count) == ("A", ["J S"], 2020, "10.1/x", "2101.00001", "a b a", 3)
    assert (b.authors, b.year, b.retracted, b.retraction_doi, b.retraction_date, b.abstract) == (["S, J", "Org"], 2019, True, "10.1/n", "2021-3-4", "Hi")
    assert (c.doi, c.work_type, c.retracted) == ("10.1/z", "review", False)
    assert (d.title, d.year, d.arxiv_id, d.open_access_url) == ("D d", 2021, "2101.00002", "u")


def test_works(spark):
    schema = works.SCHEMA + ", ord int"
    names = [p.split()[0] for p in schema.split(", ")]
    make = lambda q, n, **k: tuple({"query_id": q, "ord": n, "citation_count": None, **k}.get(c) for c in names)
    rows = [
        make("q", 1, title="A Title", authors=["J Smith"], sources=["a"], year=2021, identifiers={"x": "1"}), make("q", 2, title="A title!", authors=["Smith, J"], doi="10.1/x", sources=["b"], year=2019, citation_count=4, identifiers={"x": "2", "y": "3"}),
        make("q", 3, title="Other", doi="10.1/x", sources=["c"], retracted=True, venue="V"), make("q", 4, title="Else", sources=["d"]), make("p", 1, title="A Title", authors=["J Smith"], sources=["a"]), make(None, 1), make(None, 2),
    ]
    out = works.deduplicated(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.query_id), str(r.title)) for r in out) == [("None", "None"), ("None", "None"), ("p", "A Title"), ("q", "A title!"), ("q", "Else")]
    one = next(r for r in out if r.title == "A title!")
    assert (one.doi, one.year, one.citation_count, one.retracted, one.sources, one.venue, one.identifiers) == ("10.1/x", 2019, 4, True, ["a", "b", "c"], "V", {"x": "1", "y": "3"})
    assert works.deduplicated(spark.createDataFrame([], schema)).count() == 0


def test_resolved(spark):
    entries = spark.createDataFrame(
        [("a", "Ranking under budgets", ["smith"], 2020, "10.1/a", None), ("b", "Ranking under budgets", ["smith"], 2020, None, None), ("c", "Ranking under budgets", ["lee"], 2020, None, None), ("d", None, None, None, None, None), ("e", "Alone", [], None, "10.9/none", None)]
        + [("f", "Ranking under budgets", ["smith"], 2019, None, None), ("g", "Ranking under budgets", ["smith"], 2020, None, None), ("h", "Ranking under budgets", ["smith"], 2020, None, None)],
        "key string, title string, surnames array<string>, year int, doi string, arxiv_id string",
    )
    good = ("Ranking under budgets", ["smith", "lee"], 2020, "10.1/a", None, False)
    found = spark.createDataFrame(
        [("a", 1, "Another work", ["x"], 2020, "10.7/z", None, False), ("a", 2, *good), ("b", 1, "Ranking under budget limits", ["smith"], 2020, "10.1/c", None, False), ("b", 2, *good), ("c", 1, "Machine learning under budget constraints", ["kim"], 2020, "10.1/d", None, False), ("e", 1, "Alone", [], None, "10.8/other", None, False)]
        + [("f", 1, *good), ("g", 1, *good[:5], True), ("h", 1, *good[:3], None, "2101.00001", False)],
        "key string, ord int, title string, surnames array<string>, year int, doi string, arxiv_id string, retracted boolean",
    )
    got = {r.key: (r.verdict, r.work_title) for r in works.resolved(entries, found).collect()}
    fine = "Ranking under budgets"
    assert got == {"a": ("VERIFIED", fine), "b": ("VERIFIED", fine), "c": ("NOT_FOUND", None), "d": ("UNPARSEABLE", None), "e": ("NOT_FOUND", None), "f": ("YEAR_MISMATCH", fine), "g": ("RETRACTED", fine), "h": ("PREPRINT_ONLY", fine)}


def test_cache_keys_and_pages(spark):
    urls = ["https://X.org/p?b=2&a=1", "https://x.org/p?a=1&b=2", "https://x.org/p?a=0&b=2&a=1"]
    keys = {r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(cache.cache_key(cache.request_line(F.lit("get"), F.col("u"))).alias("k")).collect()}
    assert len(keys) == 1
    html = "<style>x</style><h1>Head</h1><p>One &amp; two<br>three</p><script>1<2</script><div>four</div>"
    assert spark.createDataFrame([(html,)], "h string").select(files.html_text(F.col("h")).alias("t")).first().t == "Head\n\nOne two\n\nthree\n\nfour"


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "h1"), ("b", 2, "h2"), ("c", 3, "h3")], "doc_id string, n int, h string")
    files.write_artifact(rows, str(tmp_path / "a"), "voice", F.col("h"))
    back = files.read_artifact(spark, str(tmp_path / "a"), "voice")
    current = spark.createDataFrame([("a", "h1"), ("b", "changed")], "doc_id string, source_hash string")
    assert {r.doc_id: r.stale for r in files.stale(back, current).collect()} == {"a": None, "b": "source_changed", "c": "no_source"}
    assert json.loads(back.where("doc_id = 'b'").first().payload)["n"] == 2


def test_report(spark):
    row = spark.range(1).select(report.markdown(F.lit("T"), F.array(F.lit("a"), F.lit("b"))).alias("m"), report.html_escape(F.lit('<a & "b">')).alias("h"), report.breaches({"x": F.lit(3), "y": F.lit(0)}, {"x": 2, "y": 0}).alias("b"), report.gaps({"p": F.lit(False), "q": F.lit(True)}).alias("g")).first()
    assert (row.m, row.h, row.b, row.g) == ("# T\n\n* a\n* b\n", "&lt;a &amp; &quot;b&quot;&gt;", ["x"], ["p was not checked"])
