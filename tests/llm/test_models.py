import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import language_id, packing, topk, toxicity

SYLLABLES = {"aa": ["tha", "ing", "ed", "sh"], "bb": ["ück", "sch", "ein", "ung"], "cc": ["ción", "ll", "que", "ñ"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, rng.randint(15, 60)), lang, "x") for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    mixed = (900, text(rng, "aa", 60) + ". " + text(rng, "bb", 30), None, "x")
    odd = [(901, None, "aa", ""), (902, "", None, ""), (903, "12 !? 3", "bb", ""), (904, text(rng, "cc", 3000), None, "")]
    df = spark.createDataFrame([*rows, mixed, *odd, rows[0]], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert {r.doc_id: r.held_out for r in got.values()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
    assert set(got[900].lang_mix) == {"aa", "bb"} and abs(got[900].score - 2 / 3) < 0.1
    assert [(got[i].lang_pred, got[i].score) for i in (901, 902, 903)] == [("und", 0.0)] * 3
    assert got[904].lang_pred == "cc" and set(got[904].lang_mix) == {"cc"}
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.identify(df.where("lang is null and doc_id = 900"))
    assert [r.lang_pred for r in nothing.collect()] == ["und"]
    assert language_id.identify(df.limit(0)).count() == 0


def test_language_sets_are_those_of_all_sets(spark):
    """Against brute force: of all sets of languages, climbed by plain loops, none has a better penalised likelihood."""
    from itertools import combinations
    from math import exp, log

    import pyarrow as pa

    rng = random.Random(7)
    learn = [(text(rng, lang, 40), lang) for lang in SYLLABLES for _ in range(30)]
    counts = np.zeros((3, language_id.BUCKETS))
    for t, lang in learn:
        np.add.at(counts[sorted(SYLLABLES).index(lang)], language_id.Grams(pa.array([t])).grams, 1)
    model = language_id.Model(sorted(SYLLABLES), counts)
    texts = [text(rng, "aa", 30), text(rng, "bb", 9) + " " + text(rng, "aa", 21), text(rng, "cc", 2), " ".join(text(rng, x, 25) for x in SYLLABLES), text(rng, "cc", 80) + " " + text(rng, "aa", 2)]
    got, docs = model.mixtures(language_id.Grams(pa.array([*texts, None, "..."])))
    assert docs.tolist() == list(range(len(texts)))

    def likelihood(p, pi):
        return sum(log(max(1e-300, sum(x * q for x, q in zip(w, pi, strict=True)))) for w in p)

    for row, t in zip(got, texts, strict=True):
        ll = model.word_likelihoods(language_id.Grams(pa.array([t])))
        p = [[exp(x - max(w)) for x in w] for w in ll.tolist()]
        best = -1e300
        for m in (1, 2, 3):
            for some in combinations(range(3), m):
                pi = [1 / m if k in some else 0.0 for k in range(3)]
                for _ in range(300):
                    r = [[x * q / sum(a * b for a, b in zip(w, pi, strict=True)) for x, q in zip(w, pi, strict=True)] for w in p] if m > 1 else [pi] * len(p)
                    pi = [sum(c) / len(p) for c in zip(*r, strict=True)]
                best = max(best, likelihood(p, pi) - language_id.PENALTY * (m - 1) * log(len(p) + 1))
        used = int((row > 0).sum())
        assert abs(row.sum() - 1) < 1e-9
        assert likelihood(p, row.tolist()) - language_id.PENALTY * (used - 1) * log(len(p) + 1) >= best - 0.02
    assert [int((row > 0).sum()) for row in got[:2]] == [1, 2]


def test_languages_beyond_64_and_other_scripts(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = {f"l{k:02}": rng.sample([a + b for a in letters for b in letters], 4) for k in range(70)} | {"zh": ["の", "漢", "字", "語"], "ru": ["да", "нет", "Что", "Это"]}
    make = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(alphabets[lang], 40), lang) for i, lang in enumerate(list(alphabets) * 4)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.97 * len(rows)


def test_obfuscations_are_undone():
    plain = ["you are an idiot and a loser", "what a worthless moron he is", "stupid clown and scum", "that is disgusting trash", "the other of them is there"] * 30
    restore = toxicity.Restorer(toxicity.CharacterModel(toxicity.trigram_counts(plain)))
    pairs = {"an 1d10t here": "an idiot here", "m0r0n": "moron", "i d i o t": "idiot", "l.o.s.e.r": "loser", "w0rthl3ss $cum": "worthless scum", "idiooooot": "idiot", "st*pid": "stupid", "tr@sh and cl0wn": "trash and clown"}
    for given, want in pairs.items():
        assert restore([given]) == [want], given
    kept = ["The other: 3.14 or 12:30, there!!", "", "a%%% the*** $$$"]
    assert restore([*kept, None]) == [*(k.lower() for k in kept), ""]


def test_signs_at_the_end_and_in_long_runs_are_undone():
    plain = ["you are an ass and full of shit", "oh hello what a bitch", "a bit of it", "such an idiot", "go there now", "the house is green"] * 30
    restore = toxicity.Restorer(toxicity.CharacterModel(toxicity.trigram_counts(plain)))
    pairs = {"an a55 here": "an ass here", "a$$": "ass", "sh17": "shit", "bi7": "bit", "h3110": "hello", "idi07": "idiot", "1d1o7": "idiot", "b17ch": "bitch", "idiot!": "idiot!", "house 2024 100% there!!": "house 2024 100% there!!"}
    for given, want in pairs.items():
        assert restore([given]) == [want], given


def test_readings_are_the_cheapest_of_all():
    """Against brute force: of all readings of a span's lattice none is cheaper."""
    from itertools import product

    plain = ["you are an idiot and a loser", "what a worthless moron he is", "stupid clown and scum", "漢字 の 語"] * 30
    model = toxicity.CharacterModel(toxicity.trigram_counts(plain))

    def cost(lattice, reading):
        a = b = 0
        total = 0.0
        for letters, extra in reading:
            more, a, b = model.read(a, b, letters)
            total += extra + more
        return total + model.end(a, b)

    for span in ("1d10t", "i.d.i.o.t", "st*p1d", "m0r0n!", "a$$", "cl###wn", "w0rthl3", "idiooot", "s-c..m", "漢*語"):
        lattice = model.options(span)
        cheapest = min(cost(lattice, r) for r in product(*lattice))
        assert any(abs(cost(lattice, r) - cheapest) < 1e-6 for r in product(*lattice) if "".join(x for x, _ in r) == model.restore(span)), span


def test_long_runs_and_other_scripts_are_suspicious():
    found = lambda t: bool(toxicity.SUSPICIOUS.search(t)) and bool(toxicity._flagged([t]))
    assert all(map(found, ["id$$$$$$iot", "lo----ser", "m......oron", "####moron", "漢*語", "a55"]))
    assert not any(toxicity._flagged([t]) for t in ["plain words, here.", "12 + 30 = 42", "漢字"])


def test_toxicity(spark):
    rng = random.Random(6)
    marks = ["idiot", "moron", "worthless"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = [rng.choice(["the", "house", "green", "walks", "over", "there", "some", "idea"]) for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(marks)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic)))
    rows += [(1000, None, 0.1), (1001, "", 0.1), (1002, "such an 1d10t", 0.1), (1003, "green house " * 9000, 0.1)]
    labels += [(None, 1), (7777, 1), (3, 0), (1001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, known).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in held if not got[i].held_out] == []
    assert all(got[i].predicted == (i % 4 == 0) for i in held)
    assert got[1002].predicted == 1
    assert [got[i].predicted for i in (1000, 1001, 1003)] == [0, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.predicted for r in toxicity.judge(docs, known.limit(0)).collect()} == {0}
    assert toxicity.judge(docs.limit(0), known).count() == 0


def brute(rows, k, every):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine.setdefault(len(v), []).append((i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)))
    out = []
    for group in fine.values():
        for q, v in group:
            if q % every == 0:
                best = sorted((-int(v @ w), i) for i, w in group if i != q)[:k]
                out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_is_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 16), (2300, [0.5, -0.25]), (2301, [0.1, 0.1]), (None, rows[1][1]), (2400, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.search(df, every=50).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 10, 50)
    assert topk.search(df.limit(0)).count() == 0


def test_topk_takes_every_finite_component(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(120)]
    rows += [(200, [3e6, 1.0, 0.0, -2.0]), (201, [-3e6, 0.5, 0.25, 0.0]), (202, [1e200, 0.0, 0.0, 1.0]), (300, [1e308, -1e308, 0.0, 0.0]), (301, [0.0, 5e-324, -5e-324, 2.0**40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(df, every=20).select("query_id", "rank", "vec_id", "score").collect())
    whole = {i: [int(np.floor(x * 1024)) if abs(x) < 1e300 else int(x) * 1024 for x in v] for i, v in rows}
    want = []
    for q in sorted(i for i in whole if i % 20 == 0):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    assert got == want


def test_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8 if i % 3 else 5)]) for i in range(600)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, dims int")
    assert sorted(tuple(r) for r in topk.search(df, every=20).select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 10, 20)


def test_bit_slices():
    rng = np.random.default_rng(1)
    values = rng.integers(-700, 700, (333, 5))
    b = topk.BitSlices(values)
    weights = rng.integers(-40, 40, 5)
    total = b.sums(weights)
    sums = b.coarse @ weights
    assert (b.values_of(total, np.arange(333)) == sums).all()
    for least in (int(sums.min()) - 1, -17, 0, 5, int(np.median(sums)), int(sums.max()), -(10**9), 10**9 % (1 << len(total) - 1)):
        assert set(b.rows(b.at_least(total, least))) == set(np.flatnonzero(sums >= least))
    for k in (1, 10, 333, 500):
        kth = np.sort(sums)[::-1][min(k, 333) - 1]
        assert set(b.rows(b.at_least_kth(total, k))) == set(np.flatnonzero(sums >= kth))


def least_padding(lengths, buckets):
    from itertools import combinations

    different = sorted(set(lengths))
    best = None
    for n in range(1, min(buckets, len(different)) + 1):
        for inner in combinations(different[:-1], n - 1):
            bounds = [*inner, different[-1]]
            cost = sum(min(b for b in bounds if b >= x) - x for x in lengths)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.choice([1, 2, 3, 5, 8, 13, 40, 41, 90]) for _ in range(rng.randint(1, 40))]
        values, counts = np.unique(lengths, return_counts=True)
        for buckets in (1, 2, 3, 5):
            bounds = packing.boundaries(values, counts, buckets)
            assert len(bounds) <= buckets and bounds[-1] == max(lengths)
            assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == least_padding(lengths, buckets)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([3, 4, 10, 11, 50, 400, 90_000]), "x") for i in range(700)] + [(5, 3, "x"), (5, 3, "x"), (None, 7, "x"), (800, None, "x"), (801, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, batch string")
    got = packing.pack(df, buckets=4, budget=1000).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r.bucket_length >= (r.n_tokens or 0)
        batches.setdefault(r.batch, []).append(r)
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1
        assert sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_length <= 1000
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.where("n_tokens is null")).select("bucket_length", F.col("slot")).collect() == [(0, 0)]


def test_one_huge_document_leaves_the_other_bounds_alone(spark):
    rng = random.Random(12)
    for longest in (90, 1_000_000, 5_000_000):
        lengths = [rng.choice([1, 2, 17, 30, 31, 200, 245, 246, 3000]) for _ in range(200)] + [longest]
        got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), buckets=4).collect()
        assert sum(r.bucket_length - r.n_tokens for r in got) == least_padding(lengths, 4)


def test_boundaries_of_many_lengths_are_optimal():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 40_000, 700))
    counts = rng.integers(1, 50, len(lengths))
    cost = lambda i, j: int((counts[i:j] * (lengths[j - 1] - lengths[i:j])).sum())
    n = len(lengths)
    table = np.array([[cost(i, j) if i < j else 1 << 60 for j in range(n + 1)] for i in range(n)])
    best = table[0]
    for _ in range(3):
        best = np.minimum(best, (best[:n, None] + table).min(axis=0))
        best[0] = 0
    bounds = np.array(packing.boundaries(lengths, counts, 4))
    assert int((counts * (bounds[np.searchsorted(bounds, lengths)] - lengths)).sum()) == best[n]


def test_slices_of_one_weight_are_added_together(monkeypatch):
    """Sums over many attributes take few steps of arithmetic on whole matrices of bitmaps, not one for each bit."""
    rng = np.random.default_rng(5)
    values, weights = rng.integers(-900, 900, (1_000, 300)), rng.integers(-60, 60, 300)
    b = topk.BitSlices(values)
    calls = []
    for name in ("bitwise_and", "bitwise_xor"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **k: calls.append(1) or f(*a, **k))
    total = b.sums(weights)
    assert len(calls) < 1_000
    assert (b.values_of(total, np.arange(1_000)) == b.coarse @ weights).all()
