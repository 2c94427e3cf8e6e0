import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import graph, line_dedup, near_dedup, quality_rules
from quillgraph.llm.graph import bucket_components, components
from quillgraph.llm.shared import materialise

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0d]+", text.translate(LOWER) if lower else text)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def corpus(seed=5):
    """(doc_id, text): exact and near copies around the threshold, a shared passage, short, empty and null texts, a repeated row."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(60, 140))] for _ in range(8)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for edits in (0, 1, 1, 2, 3, 4, 6, 9):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c).upper() if edits == 1 else "\n".join(c))
        texts.append(" ".join(passage + b[:20]))
    texts += ["", None, " \n", "one", "One", "one two", "one  two", "É x y z", "a b c", "a b c a b c a b c"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)] + [(order.index(3), texts[3])]


def expected(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(parent, x), find(parent, y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(parent, i), find(parent, i) == i) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_all_pairs(spark, size, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1.5) for i, t in rows], "doc_id long, text string, component_id string, other double").repartition(3)
    got = near_dedup.near_duplicates(df, size=size, percent=percent).collect()
    assert len(got) == len(rows)
    want = expected(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert sum(not k for _, _, k in want.values()) > 20
    assert {r.other for r in got} == {1.5}


def test_near_duplicates_of_nothing_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, ""), (None, "q r s t u v")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True), ("None", "4", False), ("None", "None", True), ("None", "None", True)]


def test_sketches_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (30, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.concatenate([a[: int(n * 0.92)], np.unique(rng.integers(0, 2**63, int(n * 0.08), dtype=np.uint64))])
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        pop = lambda x: int(np.bitwise_count((x[0] ^ x[1]).view(np.uint64)).sum())
        assert 185 * pop(near_dedup.parities([a, np.sort(b)])) <= 15 * (len(a) + len(b))
        assert pop(near_dedup.odd_sketches(near_dedup.min_hashes([a, b]))) <= near_dedup.difference_limit(0.85)


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    parent = {x: x for e in links for x in e}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for e in links if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def apart(x, y):
    """Symbols in which two SimHashes (lo, hi) differ."""
    return sum(any((p ^ q) >> line_dedup.LANE * j + k & 1 for j in range(line_dedup.BITS)) for p, q in zip(x, y, strict=True) for k in range(line_dedup.HALF))


def hashes_of(spark, lines):
    """SimHash of each line by its words joined with spaces."""
    df = spark.createDataFrame([(0, x) for x in lines], "doc_id int, text string")
    found = line_dedup.lines_of(df, "doc_id", "text").withColumn("norm", F.array_join("words", " ")).dropDuplicates(["norm"])
    return {r.norm: (r.lo, r.hi) for r in line_dedup.sim_hashes(found, ["norm"]).collect()}


def similar(a, b, least=0.8):
    if max(len(a), len(b)) > line_dedup.LONG:
        a, b = a.split(), b.split()
    return levenshtein(a, b) <= int((1 - least) * max(len(a), len(b)) + 1e-9)


def test_line_groups_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(80)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(6, 60))) for _ in range(12)]
    docs = []
    for i in range(25):
        own = []
        for _ in range(3):
            w = rng.choice(lines).split()
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            own.append((" ".join(w) + ("!!" if rng.random() < 0.3 else "")).capitalize())
        docs.append((i, "\n".join([*own, "short line", "- -", ""])))
    docs += [(50, None), (51, ""), (3, docs[3][1]), (52, "\n\n"), (53, "Short? line"), (None, "...\nword1\nword1")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, n_lines string, bucket string")
    normal = lambda t: re.sub(r"[^\w]+", " ", t.lower()).strip()
    hashed = hashes_of(spark, [t for _, t in docs if t])
    names = sorted(hashed)
    parent = {n: n for n in names}
    fuzzy = 0
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if apart(hashed[a], hashed[b]) <= line_dedup.DISTANCE and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and similar(a, b):
                fuzzy += 1
                parent[find(parent, b)] = find(parent, a)
    assert fuzzy > 20
    seen, want = set(), {}
    for i, t in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d)):
        kept = []
        for line in t.split("\n"):
            n = normal(line)
            if n and find(parent, n) in seen:
                continue
            if n:
                seen.add(find(parent, n))
            kept.append(line)
        want[i] = ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in got if r.doc_id != 50} == want
    assert [(r.text, r.n_lines, r.n_removed_lines, r.bucket) for r in got if r.doc_id == 50] == [(None, 0, 0, "y")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert line_dedup.duplicate_lines(df.limit(0)).count() == 0


def test_a_changed_word_is_found(spark):
    """Recall against edit similarity alone: of lines with a word replaced, put in or left out, at least 0.95 are linked."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 3, 3, 4, 5, 6, 7, 9]))) for _ in range(3000)]
    pairs = []
    for k in range(240):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        c = list(w)
        at = rng.randrange(len(c))
        c[at : at + (k % 3 != 1)] = [rng.choice(vocabulary)] if k % 3 < 2 else []
        pairs.append((" ".join(w), " ".join(c)))
    hashed = hashes_of(spark, [x for p in pairs for x in p])
    alike = [(a, b) for a, b in pairs if levenshtein(a, b) <= 0.2 * max(len(a), len(b)) and a != b]
    assert len(alike) > 150
    linked = [apart(hashed[a], hashed[b]) <= line_dedup.DISTANCE and similar(a, b) for a, b in alike]
    assert sum(linked) >= 0.95 * len(alike)


def test_long_lines(spark):
    """Lines of 40,000 words with a few changes are one group; a line of 120,000 characters without a space is no trouble."""
    rng = random.Random(6)
    long = [f"v{rng.randrange(5000)}" for _ in range(40_000)]
    other = list(long)
    other[17] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, "x" * 120_000), (4, "x" * 119_999 + "y"), (5, " ".join(reversed(long)))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.text} == {1, 3, 4, 5}


def test_pigeonhole_blocks_meet(spark):
    rng = random.Random(1)
    symbol = lambda lo, hi, k, v: (lo ^ v if k < 10 else lo, hi if k < 10 else hi ^ v)
    rows = []
    for i in range(80):
        a = tuple(sum(rng.getrandbits(1) << b for b in range(50)) for _ in range(2))
        b = a
        for k in rng.sample(range(20), rng.randint(0, 2)):
            b = symbol(*b, k, sum(1 << line_dedup.LANE * j + k % 10 for j in rng.sample(range(5), rng.randint(1, 5))))
        assert apart(a, b) <= 2
        rows += [(i, *a), (i, *b)]
    df = spark.createDataFrame(rows, "pair int, lo long, hi long").withColumn("node", F.monotonically_increasing_id())
    buckets = df.withColumn("bucket", F.explode(F.array(*line_dedup.sim_blocks())))
    met = lambda d: d.groupBy("bucket", "pair").count().where("count > 1").select("pair").distinct().count()
    assert met(buckets) == 80
    assert met(line_dedup.divided(buckets)) == 80
    x, y = df.alias("x"), df.alias("y")
    near = x.join(y, (F.col("x.pair") == F.col("y.pair")) & (F.col("x.node") < F.col("y.node"))).select(line_dedup.symbols_apart("x", "y").alias("d"), "x.lo", "x.hi", F.col("y.lo").alias("l"), F.col("y.hi").alias("h"))
    assert all(r.d == apart((r.lo, r.hi), (r.l, r.h)) for r in near.collect())


def test_a_bucket_of_thousands_of_components(spark):
    """One bucket's members agree on three blocks; links are exactly those of all pairs, found without making all pairs."""
    rng = random.Random(2)
    rest = lambda: sum(rng.getrandbits(1) << line_dedup.LANE * j + k for j in range(5) for k in range(8))
    sims = [(rest(), 0) for _ in range(3000)]
    sims += [(lo ^ 1 << 10 * rng.randrange(5) + rng.randrange(8), hi) for lo, hi in sims[:300]]
    nodes = spark.createDataFrame([(i, *s) for i, s in enumerate(sims)], "node long, lo long, hi long")
    buckets = nodes.select("node", F.explode(F.array(*line_dedup.sim_blocks())).alias("bucket")).select("bucket", "node")
    tested = []

    def verify(pairs):
        tested.append(pairs.count())
        return materialise(pairs, "links")

    near = lambda x, y: line_dedup.symbols_apart(x, y) <= 2
    roots = {r.node: r.root for r in bucket_components(buckets, nodes, near, verify, line_dedup.divided).collect()}
    parent = list(range(len(sims)))
    for i, a in enumerate(sims):
        for k in range(i):
            z = a[0] ^ sims[k][0]
            if z and (z | z >> 10 | z >> 20 | z >> 30 | z >> 40 & 1023) & 1023 in SMALL or not z:
                x, y = find(parent, i), find(parent, k)
                parent[max(x, y)] = min(x, y)
    want = {i: find(parent, i) for i in range(len(sims))}
    assert {i: roots.get(i, i) for i in want} == want
    assert sum(tested) < 20 * len(sims)


SMALL = {x for x in range(1024) if x.bit_count() <= 2}


def test_quality_counts_and_verdicts(spark):
    good = " ".join(f"t{i}" for i in range(60))
    common = "All Rights  reserved here"
    rows = [(i, f"{common}\n" + " ".join(f"v{i}x{k}" for k in range(55)), "h1") for i in range(6)]
    rows += [(10, good, "h2"), (11, "a b c " * 30, None), (12, None, "h1"), (13, "", "h1"), (14, "\n".join(["same old line #1"] * 20) + " é€", None), (15, good, "h2"), (15, good, "h2")]
    rows += [(20 + i, "\n".join([common.lower()] * 10 + [f"q{i}w{k}" for k in range(12)]), "h1") for i in range(3)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_words int")
    got = {r.doc_id: r for r in quality_rules.judge(df, min_docs=4, min_share=0.1).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, t, _ in rows:
        w = words(t, lower=False)
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert got[0].n_removed_words == 4 and got[0].kept
    assert got[20].n_removed_words == 40 and not got[20].kept
    assert got[10].kept and got[15].kept
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_counts_documents_and_lines_of_any_length(spark):
    """A notice of 40 words on every document of a host is removed; of the copies of one document each counts."""
    notice = " ".join(f"legal{k}" for k in range(40))
    rows = [(i, notice + "\n" + " ".join(f"v{i}x{k}" for k in range(50)), "h1") for i in range(6)]
    copy = " ".join(f"c{k}" for k in range(60))
    rows += [(20 + i, copy, "h2") for i in range(6)] + [(20, copy, "h2"), (40, " ".join(f"u{k}" for k in range(60)), "h2"), (None, notice, "h1"), (41, notice + " x\n" + notice, "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_removed_words, r.kept) for r in quality_rules.judge(df, min_docs=5, min_share=0.1).collect()}
    assert got == {i: (40, True) for i in range(6)} | {20 + i: (60, False) for i in range(6)} | {40: (0, True), None: (40, False), 41: (40, False)}


def test_quality_cuts_frequent_lines_out(spark):
    own = ["\n".join(" ".join(f"v{i}x{k}y{j}" for k in range(30)) for j in range(2)) for i in range(6)]
    rows = [(i, "All Rights  reserved\n\n" + t.replace("\n", "\nall rights RESERVED\n") + "\n", "h1") for i, t in enumerate(own)]
    rows += [(10, "all rights reserved\n" + own[0].replace("v", "z"), "h2"), (11, None, "h1"), (12, "", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df, min_docs=4, min_share=0.1, keep_text=True).collect()}
    assert {i: got[i].text for i in got} == {i: "\n" + own[i] + "\n" if i < 6 else t for i, t, _ in rows}
    assert [got[i].n_removed_words for i in (0, 10, 11)] == [6, 0, 0] and got[0].kept
    plain = {r.doc_id: r for r in quality_rules.judge(df, min_docs=4, min_share=0.1).collect()}
    assert all("text" not in r and r.kept == got[i].kept and r.n_words == got[i].n_words for i, r in plain.items())


def test_lines_to_compare_are_cut_out_before_they_are_shuffled(spark):
    texts = [(n, "\n".join(f"line {i} of text {n}" for i in range(200))) for n in range(50)] + [(None, "a null id\nhas lines")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    places = [(7, 3), (7, 199), (11, 0), (None, 1)]
    wanted = spark.createDataFrame(places, "_id long, line int").join(df, F.col("_id").eqNullSafe(F.col("doc_id"))).select("_id", F.xxhash64("text").alias("_text"), "line")
    cut = line_dedup.lines_at(df, "doc_id", "text", wanted)
    got = {(r._id, r.line): r.raw for r in cut.collect()}
    by_id = dict(texts)
    assert all(got[i, k] == by_id[i].split("\n")[k] for i, k in places)
    assert len(got) < 20
    # whole texts are in no exchange
    assert "hashpartitioning(_slot" not in cut._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def generated(plan):
    """Rows that each explode of an executed plan has made."""
    own = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName() == "Generate" else []
    return own + [n for k in range(plan.children().size()) for n in generated(plan.children().apply(k))]


def test_words_vote_in_groups_and_lose_no_vote(spark):
    import xxhash

    rng = random.Random(9)
    lines = [[rng.choice("abcdefgh") * rng.randint(1, 8) + str(rng.randrange(90)) for _ in range(n)] for n in [*range(1, 20), 63, 64, 65, 900]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lines)] + [(90, []), (91, None)], "id int, words array<string>").coalesce(1)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hashed = line_dedup.sim_hashes(df, ["id"])
        rows = hashed._jdf.collectToPython() and generated(hashed._jdf.queryExecution().executedPlan())
        got = {r.id: (r.lo, r.hi) for r in hashed.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = {}
    for i, line in enumerate(lines):
        half = [0, 0]
        for k in range(line_dedup.CLASSES):
            own = []
            for w in line:
                h = xxhash.xxh64(w.encode(), seed=42).intdigest()
                if (h - (h >> 63 << 64)) % line_dedup.CLASSES == k:
                    own.append((h, max(1, min(4, len(w) - 2))))
            for j in range(line_dedup.BITS):
                ones = sum(weight for h, weight in own if h >> line_dedup.LANE * (j + 1) & 1)
                half[k // line_dedup.HALF] |= (2 * ones > sum(weight for _, weight in own)) << line_dedup.LANE * j + k % line_dedup.HALF
        want[i] = tuple(half)
    assert got == want
    assert rows and sum(rows) <= sum(-(-len(w) // 8) for w in lines) + 2


def test_texts_are_hashed_once_and_not_for_each_line(spark):
    df = spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")
    plan = line_dedup.lines_of(df, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(") == 1 and plan.index("Generate") < plan.index("xxhash64(")


def test_a_line_just_below_the_length_compared_by_words_meets_one_above(spark):
    line = " ".join(f"word{i:03d}" for i in range(31))
    rows = [(1, line + " ende"), (2, line + " enderoderanders")]
    assert [len(t) for _, t in rows] == [252, 263]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed_lines for r in got} == {1: 0, 2: 1}


def test_only_what_the_result_reads_is_left_of_line_dedup(spark, tmp_path, monkeypatch):
    left = []
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name, f=line_dedup.materialise: left.append(f(df, name)) or left[-1])
    line_dedup.dedup_lines(spark.createDataFrame([(1, "one two three\none two three"), (2, "four five")], "doc_id long, text string")).collect()
    kept = [x.scratch for x in left if os.path.exists(x.scratch.removeprefix("file://"))]
    assert len(kept) == 1 and "removed-lines" in kept[0]


def test_near_copies_across_components_are_compared_by_compiled_code(spark, monkeypatch):
    """The JVM leaves methods of more than 8,000 bytes of bytecode to its interpreter."""
    held, sizes = graph.materialise, []
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # code of a plan not yet run is known without it only

    def watching(df, name):
        if name == "across":
            text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
            sizes.extend(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))
        return held(df, name)

    monkeypatch.setattr(graph, "materialise", watching)
    try:
        df = spark.createDataFrame(corpus(), "doc_id long, text string")
        got = near_dedup.near_duplicates(df, size=3, percent=85).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected(corpus(), 3, 85)
    assert sizes and max(sizes) < 8000
