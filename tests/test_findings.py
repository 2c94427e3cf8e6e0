import random

from pyspark.sql import functions as F

from quillgraph.operators import findings as fd
from quillgraph.operators import grounding as gr
from quillgraph.operators import layout, rules, stats, trace


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_phrases_are_found_with_their_ranges(spark):
    text = "It is, in order  to win, very\tunique (e.g. this). In order to."
    rows = spark.createDataFrame([("d", "s1", 100, text), ("d", "s2", 0, None), ("d", "s3", 0, "")], "doc_id string, sentence_id string, start int, text string")
    lex = spark.createDataFrame([("in order to", "filler"), ("very unique", "intensifier"), ("(e.g.", "mark"), ("absent", "x")], "phrase string, rule string")
    found = fd.located(rows, lex)
    found = found.withColumns(fd.widened(F.col("start"), F.col("end"), F.col("before"), F.col("after")))
    got = sorted((r.start - 100, r.end - 100, r.rule, r.cut_start - 100, r.cut_end - 100) for r in found.collect())
    assert [(text[a:b], rule) for a, b, rule, _, _ in got] == [("in order  to", "filler"), ("very\tunique", "intensifier"), ("(e.g.", "mark"), ("In order to", "filler")]
    assert [text[c:d] for *_, c, d in got] == ["in order  to ", "very\tunique ", "(e.g. ", " In order to"]
    met = rules.phrase_hits(rows, lex.where("rule = 'filler'"), 3, "doc_id", "sentence_id")
    assert fd.located(rows, lex.where("rule = 'filler'"), met).count() == 2


def test_selections_and_orders(spark):
    rows = [("a", "high", "delete", False, "c2", 5), ("b", "high", "review", False, "c1", 9), ("c", "low", "delete", True, "c1", 1), ("d", "medium", "delete", False, "c1", 2), ("e", "high", "delete_clause", True, "c1", 3)]
    f = spark.createDataFrame(rows, "rule string, severity string, suggestion string, advisory boolean, category string, start int")
    assert [r.rule for r in fd.mechanical(f).collect()] == ["a"]
    assert {r.rule for r in fd.advisory(f).collect()} == {"c", "e"}
    assert [r.rule for r in fd.having(f, severity="medium", category="c1").collect()] == ["d"]
    assert [r.rule for r in f.orderBy(*fd.question_order()).collect()] == ["e", "b", "a", "d", "c"]
    o = spark.createDataFrame([("x", 0.5, 9, 2), ("y", 0.5, 9, 1), ("z", 0.9, 8, 3), ("w", 0.5, 20, 9)], "id string, distinctiveness double, length int, pos int")
    assert [r.id for r in o.orderBy(*fd.overlap_order()).collect()] == ["z", "w", "y", "x"]
    assert one(spark, fd.may_grow(F.col("c"), F.col("n")), c="GROUND", n=4) and not one(spark, fd.may_grow(F.col("c"), F.col("n")), c="CUT", n=1)
    assert [one(spark, fd.outside(F.col("n"), F.lit(10.0), F.lit(20.0)), n=n) for n in (4, 10, 23)] == [6.0, 0.0, 3.0]


def test_clauses_and_items(spark):
    text = "It may seem so, but this: though, perhaps"
    spans = one(spark, fd.clauses(F.col("t")), t=text)
    assert [text[s.start : s.end] for s in spans] == ["It may seem so", " ", " this", " ", " perhaps"]
    assert one(spark, fd.clauses(F.col("t")), t="") == []
    items = one(spark, fd.claim_items(F.col("t")), t="We offer (i) a method, (ii) a proof; and (iii) data.")
    assert [(i.label, i.text) for i in items] == [("(i)", "a method"), ("(ii)", "a proof; and"), ("(iii)", "data")]
    assert [one(spark, fd.claim_items(F.col("t")), t=t) for t in ("only (i) one", "none")] == [[], []]
    assert [i.text for i in one(spark, fd.claim_items(F.col("t")), t="1. first 2) second")] == ["first", "second"]


def test_novelty_findings(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    claims = spark.createDataFrame([("a", "s1", "claim " * 60, ["x", "y"], False), ("c", "s2", "fine", [], True)], "doc_id string, span_id string, text string, missing array<string>, items boolean")
    orphans = spark.createDataFrame([("a", "p1", "lost", 5, 9, "serves nothing"), ("b", "p2", "lost", 1, 2, "no claim here")], "doc_id string, span_id string, text string, start int, `end` int, reason string")
    got = sorted((r.doc_id, r.rule, r.severity, len(r.matched_text), r.note) for r in fd.novelty_findings(docs, claims, orphans).collect())
    assert got == [("a", "novelty_orphan_paragraph", "medium", 4, "serves nothing"), ("a", "novelty_unsupported_contribution", "high", 200, "not picked up: x, y"), ("b", "novelty_no_claim_found", "high", 0, None)]


def test_uses_and_claims(spark):
    uses = spark.createDataFrame([(1, "k1"), (2, "k1"), (3, "k9"), (4, None)], "use int, key string")
    entries = spark.createDataFrame([("k1", 1, "old"), ("k1", 2, "new"), ("k2", 3, "unused")], "key string, ord int, raw string")
    assert sorted((r.use, r.raw, r.listed) for r in gr.uses_with_entries(uses, entries).collect()) == [(1, "new", True), (2, "new", True), (3, None, False), (4, None, False)]
    sentences = spark.createDataFrame([("d", "s1", "one", 0), ("d", "s2", "two", 9)], "doc_id string, sentence_id string, text string, start int")
    citations = spark.createDataFrame([("d", "s1", "k", False), ("d", "s1", "k", False), ("d", "s1", "m", False), ("d", "s2", "z", True)], "doc_id string, sentence_id string, key string, in_bibliography boolean")
    assert sorted((r.sentence_id, r.key) for r in gr.cited_claims(sentences, citations).collect()) == [("s1", "k"), ("s1", "k"), ("s1", "m")]
    inside = citations.where("not in_bibliography")
    assert [r.sentence_id for r in gr.with_citation(sentences, inside).collect()] == ["s1"] and [r.sentence_id for r in gr.with_citation(sentences, inside, False).collect()] == ["s2"]
    paragraphs = spark.createDataFrame([("d", "p1", "whole", 0)], "doc_id string, paragraph_id string, text string, start int")
    found = spark.createDataFrame([("d", "s2"), ("d", "p1"), ("d", "")], "doc_id string, span_id string")
    assert {r.span_id: (r.span_text, r.span_start) for r in gr.anchored(found, sentences, paragraphs).collect()} == {"s2": ("two", 9), "p1": ("whole", 0), "": (None, None)}


def test_passages(spark):
    rows = [("b1", 0, "one two three four five"), ("b1", 1, "six seven"), ("b1", 2, "a b c d e f"), ("b2", 0, "too short here")]
    got = sorted((r.block, r.pos, r.n, r.text) for r in gr.passages(spark.createDataFrame(rows, "block string, pos int, text string"), "block").collect())
    assert got == [("b1", 0, 1, rows[0][2]), ("b1", 0, 2, rows[0][2] + " six seven"), ("b1", 1, 2, "six seven a b c d e f"), ("b1", 2, 1, "a b c d e f")]


def test_sources(spark):
    tries = spark.createDataFrame([("d", "k", True), ("d", "k", True), ("d", "m", False), ("d", None, True)], "doc string, key string, is_full_text boolean")
    assert [tuple(r) for r in gr.source_coverage(tries, "doc").collect()] == [("d", 2, 1)]
    assert [one(spark, gr.is_boilerplate(F.col("t"), ["all rights reserved"]), t=t) for t in ("  All  Rights reserved.", "rights", "other")] == [True, True, False]
    c = spark.createDataFrame([("q", 1, 0.5, "a"), ("q", 2, 0.9, "b"), ("q", 3, 0.9, "c"), ("r", 1, 0.0, "d")], "q string, ord int, score double, title string")
    assert [(r.q, r.title) for r in gr.best_candidate(c, "q").collect()] == [("q", "b")]
    both = gr.search_union({"z": spark.createDataFrame([("t",)], "title string"), "a": spark.createDataFrame([("u", 3)], "title string, year int")})
    assert sorted((r.source, r.title, r.year) for r in both.collect()) == [("a", "u", 3), ("z", "t", None)]
    assert one(spark, stats.phrase_uses(F.col("t"), ["would appear", "appear", "may"]), t="It would appear, would appear; may may. Maybe") == 6


def test_layout_is_that_of_plain_sweeps(spark):
    rng = random.Random(5)
    rows = []
    for page in range(40):
        split = page % 2
        for k in range(rng.randint(4, 12)):
            left = rng.uniform(20, 60) if not split or k % 2 else rng.uniform(320, 340)
            rows.append((page, k, left, rng.uniform(left + 30, left + (500 if not split else 230)), rng.choice([700.0, 701.2, 702.4, 650.0]), f"Page {page}" if k == 0 else f"t{k}"))
    df = spark.createDataFrame(rows, "page int, ord int, x double, `right` double, y double, text string")
    want = {}
    for page in range(40):
        own = sorted((r[2], r[3]) for r in rows if r[0] == page)
        best, at = 0.0, None
        reach = own[0][1]
        for a, b in own[1:]:
            if a - reach > best and 120 <= (a + reach) / 2 <= 480:
                best, at = a - reach, (a + reach) / 2
            reach = max(reach, b)
        if len(own) >= 6 and best >= 15:
            want[page] = at
    got = {r.page: r.gutter for r in layout.gutters(df, F.lit(600.0), "page").collect()}
    assert want and got == want
    lines = {(r.page, r.ord): r.line for r in layout.baselines(df, "ord", "page").collect()}
    for page in range(40):
        line, y = -1, None
        for r in sorted(r for r in rows if r[0] == page):
            if y is None or abs(r[4] - y) > 1.5:
                line, y = line + 1, r[4]
            assert lines[page, r[1]] == line
    heads = spark.createDataFrame([("d", 1, 790.0, "Page 1 "), ("d", 2, 790.0, "Page 2"), ("d", 1, 400.0, "Page 3"), ("d", 1, 10.0, "once")], "doc string, page int, y double, text string")
    assert sorted(r.text for r in layout.without_running(heads, F.lit(800.0), "doc", "page").collect()) == ["Page 3", "once"]
    assert one(spark, layout.dehyphenated(F.col("t")), t="lay-\nout of Re-\nAct") == "layout of Re-\nAct"


def test_deviations(spark):
    profiles = [("d", f"s{i}", 10.0, "british") for i in range(9)] + [("d", "far", 30.0, "american"), ("d", "odd", 10.0, "mixed"), ("e", "x", 1.0, "british"), ("e", "y", 9.0, "american")]
    p = spark.createDataFrame(profiles, "doc string, section string, length double, spelling string")
    whole = spark.createDataFrame([("d", 11.0, "british"), ("e", 5.0, "british")], "doc string, length double, spelling string")
    got = sorted(tuple(r) for r in trace.deviations(p, whole, "doc", ["length"], ["spelling"]).collect())
    assert got == [("d", "far", "voice_length", "30.0", "11.0"), ("d", "far", "voice_spelling", "american", "british")]
