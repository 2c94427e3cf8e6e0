from quillgraph.operators import entries, gate, synthesis, trace


def test_entries(spark):
    rows = [
        ("[1] Manning, C. D., Raghavan, P., and Schutze, H. Introduction to Retrieval. Cambridge University Press, 2008.",),
        ("Jane Smith and Bo Lee. Ranking under budgets. In Proc. ACM, 2020. doi:10.1145/3.4(5).",),
        ("arXiv:2101.00001v2",),
        (None,),
    ]
    got = entries.parsed(spark.createDataFrame(rows, "raw string")).collect()
    assert (got[0].title, got[0].year, got[0].kind, got[0].surnames) == ("Introduction to Retrieval", 2008, "book", ["manning", "raghavan", "schutze"])
    assert (got[1].title, got[1].authors, got[1].doi) == ("Ranking under budgets", ["Jane Smith", "Bo Lee"], "10.1145/3.4(5)")
    assert got[2].arxiv_id == "2101.00001"
    assert got[3].title is None and got[3].authors == []


def test_gate(spark):
    docs = spark.createDataFrame([(d, "h") for d in "abcd"], "doc_id string, source_hash string")
    full = [(d, n, "h", "0.1.3", n == "novelty") for d in "abcd" for n in gate.REQUIRED]
    change = {("b", "voice"): None, ("c", "grounding"): ("c", "grounding", "old", "0.1.0", False), ("d", "novelty"): ("d", "novelty", "h", "0.1.0", False)}
    rows = [change.get(r[:2], r) for r in full]
    got = {r.doc_id: (r.passed, r.artifact, r.reason) for r in gate.gate(docs, spark.createDataFrame([r for r in rows if r], "doc_id string, name string, source_hash string, version string, confirmed boolean"), "0.1").collect()}
    assert got == {"a": (True, None, None), "b": (False, "voice", "missing"), "c": (False, "grounding", "stale"), "d": (False, "novelty", "unconfirmed")}


def test_scope_and_evidence(spark):
    cuts = spark.createDataFrame([("d", "1", 0, 5, "x"), ("d", "2", 20, 30, "plain"), ("d", "3", 42, 44, "7%"), ("d", "4", 40, 50, "rose 3.5"), ("d", "5", 60, 70, "words"), ("d", "6", 90, 99, "words")], "doc_id string, edit_id string, start int, `end` int, original string")
    sections = spark.createDataFrame([("d", "Intro", 1, 15, 80), ("d", "Results", 2, 55, 80)], "doc_id string, title string, level int, start int, `end` int")
    paragraphs = spark.createDataFrame([("d", 21, 29), ("d", 40, 50), ("d", 60, 70), ("d", 90, 99)], "doc_id string, start int, `end` int")
    floats = spark.createDataFrame([("d", "front_matter", 0, 10)], "doc_id string, kind string, start int, `end` int")
    got = {r.edit_id: r.refused_by for r in gate.scoped(cuts, sections, paragraphs, floats).collect()}
    assert got == {"1": "cut_into_front_matter", "2": None, "3": None, "4": "cut_reports_a_measurement", "5": "cut_in_a_findings_section", "6": "cut_outside_body_section"}
    known = gate.pointers(
        spark.createDataFrame([("d", "filler", 3, 9)], "doc_id string, rule string, start int, `end` int"),
        spark.createDataFrame([("d", "s-1")], "doc_id string, span_id string"),
        spark.createDataFrame([("d", "k")], "doc_id string, key string"),
        spark.createDataFrame([("d", "s-2", "k")], "doc_id string, span_id string, key string"),
    )
    assert {r.pointer for r in known.collect()} == {"fluff:filler@3-9", "novelty:orphan:s-1", "grounding:citation:k", "grounding:claim:s-2:k"}
    edits = spark.createDataFrame([("d", "novelty:orphan:s-1"), ("d", "voice:x")], "doc_id string, evidence string")
    assert [r.evidence for r in gate.without_evidence(edits, known).collect()] == ["voice:x"]


def test_synthesis(spark):
    text = "1. It found 12 hits, 40 % of it. See [3, 9] and `smith2020`. A strong paper."
    df = spark.createDataFrame([("d", text, ["3"], ["12", "3", "9", "2020"], ["Two sources were not reached"])], "doc_id string, text string, known_keys array<string>, known_numbers array<string>, caveats array<string>")
    got = sorted((r.rule, r.quote) for r in synthesis.violations(df).collect())
    assert got == [("citation_not_in_grounding", "9"), ("citation_not_in_grounding", "smith2020"), ("lost_caveat", "Two sources were not reached"), ("number_not_in_the_artifacts", "40"), ("percentage", "40 %"), ("verdict_on_the_paper", "a strong paper")]


def test_trace(spark):
    findings = spark.createDataFrame([("d", 1, 0, "filler_opener"), ("d", 1, 1, "throat_clearing"), ("d", 2, 0, "hedge_stack"), ("d", 3, 0, "hedge_stack"), ("d", 3, 0, "hedge_stack"), ("d", 4, 0, "tricolon")], "doc string, par int, sentence int, family string")
    found = trace.signals(findings, "doc", "par")
    assert sorted((r.par, r.signal, r.weight) for r in found.collect()) == [(1, "filler", 2), (3, "hedge_stack", 2), (4, "tricolon", 1)]
    lengths = [("d", 5, 10)] * 4 + [("d", 6, n) for n in (2, 30, 7, 25, 9, 40)]
    rhythm = trace.rhythm(spark.createDataFrame(lengths, "doc string, par int, words int"), "doc", "par")
    got = {r.par: (r.standing, r.causes) for r in trace.passages(found, rhythm, "doc", "par").collect()}
    assert got == {1: ("fix", "filler"), 3: ("fix", "hedge_stack"), 4: ("review", "tricolon"), 5: ("leave", "")}
    titles = spark.createDataFrame([("3.1 Methods",), ("Method of X",), ("Results",), (None,)], "t string")
    assert [r[0] for r in titles.select(trace.is_method(titles.t)).collect()] == [True, True, False, False]
