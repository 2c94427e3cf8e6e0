import random

import corpus_pipeline
from quillgraph.llm.queries import ORACLE_SQL, QUERIES


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "lines", "near copies", "packing"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    syllables = {"aa": ["tha", "ing", "ed", "sh", "or"], "bb": ["ück", "sch", "ein", "ung", "er"]}

    def line(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = []
    for i in range(40):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, "\n".join(line(lang, 25) for _ in range(4)), lang, f"s{i % 3}"))
    near = rows[2][1].split()
    near[50] = "changed"
    rows += [(100, rows[0][1], "aa", "s0"), (101, " ".join(near), "aa", "s1"), (102, "too short", "aa", "s1"), (103, None, None, None), (104, "1 2 3 " * 40, "aa", "s1"), (105, "same word again " * 40, "aa", "s2")]
    rows += [(106, line("aa", 30) + "\n" + rows[4][1].split("\n")[0] + "\n" + line("aa", 30), "aa", "s0")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r.doc_id for r in docs.collect()}
    clean = set(range(40))
    assert kept["language"] == {r[0] for r in rows} - {103, 104}
    assert kept["quality"] == kept["language"] - {102, 105}
    assert 100 not in kept["lines"] and clean | {101, 106} <= kept["lines"]
    assert kept["near copies"] == kept["lines"] - {101}
    texts = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    assert texts[106].text.count("\n") == 1 and texts[106].n_chars == len(texts[106].text)
    assert kept["packing"] == kept["near copies"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["packing"]


def test_quality_stage_writes_texts_less_frequent_lines(spark):
    rows = [(i, "Subscribe now\n" + " ".join(f"v{i}x{k}" for k in range(60)), "aa", "s0", 0) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality(spark, docs, "").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {i: (t.split("\n")[1], len(t.split("\n")[1])) for i, t, *_ in rows}


def test_lines_stage_keeps_what_no_other_document_holds(spark):
    shared = "\n".join(" ".join(f"s{j}w{k}" for k in range(40)) for j in range(6))
    rows = [(1, shared), (2, shared + "\nonly this document says so"), (3, shared), (4, shared + "\n\n \n")]
    docs = spark.createDataFrame([(i, t, "aa", "s0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.lines(spark, docs, "").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {1: (shared, len(shared)), 2: ("only this document says so", 26)}
