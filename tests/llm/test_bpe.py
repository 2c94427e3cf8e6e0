import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import bpe_codec, range_coder, token_counts, token_files
from quillgraph.llm.bpe import Vocabulary, memo
from quillgraph.llm.shared import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
TEXTS = [
    "Hello world, it's a test's test we'll 'd pass!'s", "", " ", "\n\n  x \t\n", "a" * 3000, "ab" * 900, "ÀÉî straße İstanbul ΑΣ Σας",
    "x<|endoftext|>y<|startoftext|> z", "日本語 한글 😀👍🏽 é", "12 345 1,000.5", "\x1c\x85 a b", "don't'll", "%%% *** $$$",
]


def library(name):
    return tokenizers.Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize(("name", "method"), [(WORD, "speculate"), (BYTE, "merge_synchronously"), (BYTE, "speculate"), (WORD, "merge_synchronously"), (BYTE, "library"), (WORD, "library")])
def test_ids_are_the_librarys(name, method):
    ids, counts = memo(tokenizer_path(name), method).text_ids(TEXTS)
    ends = np.cumsum(counts)
    for i, want in enumerate(library(name).encode_batch(TEXTS, add_special_tokens=False)):
        assert ids[ends[i] - counts[i] : ends[i]].tolist() == want.ids, TEXTS[i]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n'stmdrvel<|>")), max_size=40), max_size=4))
def test_any_text(texts):
    for name, method in ((WORD, "speculate"), (BYTE, "merge_synchronously"), (BYTE, "library")):
        ids, counts = memo(tokenizer_path(name), method).text_ids(texts)
        want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)] if texts else []
        assert ids.tolist() == [x for w in want for x in w]
        assert counts.tolist() == [len(w) for w in want]


def test_a_full_memo_starts_again():
    m = memo(tokenizer_path(BYTE), "merge_synchronously")
    before, m.limit = m.limit, 3
    try:
        for _ in range(3):
            assert m.text_counts(["one two three four five six", "x日本語"]).tolist() == [len(e.ids) for e in library(BYTE).encode_batch(["one two three four five six", "x日本語"], add_special_tokens=False)]
    finally:
        m.limit = before


def test_incompatible_pairs_are_found():
    v = Vocabulary(tokenizer_path(BYTE))
    rng = np.random.default_rng(3)
    a, b = rng.choice(v.made, 4000), rng.choice(v.made, 4000)
    spelled = [v.strings[i] + v.strings[j] for i, j in zip(a, b, strict=True)]
    unbyte = {c: k for k, c in enumerate(__import__("quillgraph.llm.bpe", fromlist=["byte_chars"]).byte_chars())}
    raw = [bytes(unbyte[c] for c in s) for s in spelled]
    lengths = np.array([len(r) for r in raw])
    ids, counts = v.merge_synchronously(v.base[np.frombuffer(b"".join(raw), np.uint8)], lengths)
    ends = np.cumsum(counts)
    exact = [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]
    assert v.compatible(a, b).tolist() == [x == [i, j] for x, i, j in zip(exact, a.tolist(), b.tolist(), strict=True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string, more int")


def test_codec_frames(spark):
    rows = [(i, t, "clash", "clash", 7) for i, t in enumerate([*TEXTS, None, TEXTS[0]])]
    path, lib = tokenizer_path(WORD), library(WORD)
    got = {r.doc_id: r for r in bpe_codec.round_trip(frame(spark, rows), path).collect()}
    for i, t, *_ in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want
        assert got[i].decoded == lib.decode(want, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].more) == ("clash", 7)
    digest = {r.doc_id: r for r in bpe_codec.digests(frame(spark, rows), path).collect()}
    assert digest[0].ids_sha256 == hashlib.sha256(" ".join(map(str, got[0].ids)).encode()).hexdigest()
    two = bpe_codec.decode(bpe_codec.encode(frame(spark, rows), path), path)
    assert {r.doc_id: r.decoded for r in two.collect()} == {k: r.decoded for k, r in got.items()}
    assert bpe_codec.digests(frame(spark, []), path).count() == 0


def test_counts_frame(spark):
    rows = [(i, t, "clash", "", 1) for i, t in enumerate([*TEXTS, None, "word " * 600])]
    lib = library(BYTE)
    got = {r.doc_id: r for r in token_counts.limits(frame(spark, rows), tokenizer_path(BYTE)).collect()}
    for i, t, *_ in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.limits(frame(spark, []), tokenizer_path(BYTE)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 300), st.integers(1, 19), st.integers(0, 2**31))
def test_range_coder_round_trip(lanes, steps, bits, seed):
    rng = np.random.default_rng(seed)
    x = (rng.integers(0, 1 << bits, (steps, lanes)) >> rng.integers(0, bits + 1, (steps, lanes))).astype(np.int32)
    assert (range_coder.decode(range_coder.encode(x, bits), steps, bits) == x).all()


def test_an_untried_guess_is_taken_and_earlier_codes_are_read():
    x = np.array([[0, 5], [0, 0], [7, 5], [0, 0], [0, 5], [7, 0]], np.int32)
    codes = range_coder.encode(x, 19)
    assert [len(c) for c in codes] == [8, 8]  # 16 and 12 bytes without the guess
    for way in (codes, [bytes.fromhex("c0000155526d086199b061a900000000"), bytes.fromhex("c0002cccc8147aeb85000000")]):
        assert (range_coder.decode(way, 6, 19) == x).all()


def test_full_blocks_of_rare_classes():
    x = np.zeros((range_coder.BLOCK, 3), np.int32)
    x[-90:, 0] = np.random.default_rng(1).integers(0, 1 << 19, 90)
    x[:, 1] = np.arange(range_coder.BLOCK)
    x[::7, 2] = np.arange(len(x[::7])) % 50
    assert (range_coder.decode(range_coder.encode(x, 19), range_coder.BLOCK, 19) == x).all()


def calls(f, *args):
    """How many functions a call of f calls, and its result."""
    import sys

    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = f(*args)
    finally:
        sys.setprofile(None)
    return n, out


def test_a_step_of_the_coder_is_short():
    """Classes are found for a block at once: a step of the encoder made 21 calls when it predicted, and one of the decoder 36."""
    x = (np.random.default_rng(2).zipf(1.3, (range_coder.BLOCK, 2)) % 50_000).astype(np.int32)
    n, codes = calls(range_coder.encode, x, 16)
    assert n < 10 * range_coder.BLOCK
    n, got = calls(range_coder.decode, codes, range_coder.BLOCK, 16)
    assert n < 30 * range_coder.BLOCK
    assert (got == x).all()


def test_codes_are_the_earlier_coders():
    rng = np.random.default_rng(7)
    x = (rng.integers(0, 1 << 16, (4096, 3)) >> rng.integers(4, 17, (4096, 3))).astype(np.int32)
    x[1000:1400] = x[200:600]
    codes = range_coder.encode(x, 16)
    assert [len(c) for c in codes] == [5056, 5014, 5038]
    assert hashlib.sha256(b"".join(codes)).hexdigest() == "4ca891851a2680bb8e0adbef25c1b7aa6b55234696128e8f626a4483b2f7af89"


def test_words_merged_as_columns():
    """Words about the largest sizes of a table, runs and random ones: the same ids as end to end."""
    v = Vocabulary(tokenizer_path(BYTE))
    rng = np.random.default_rng(3)
    for letters in (1, 2, 26):
        lengths = np.r_[0, 1, 2, np.repeat([9, 10, 11, 16, 17, 29, 30, 31, 40], 30), rng.integers(0, 35, 500)]
        symbols = v.base[rng.integers(97, 97 + letters, lengths.sum())]
        got, want = v.merge_synchronously(symbols, lengths), v._merge_ragged(symbols, lengths)
        assert got[0].tolist() == want[0].tolist()
        assert got[1].tolist() == want[1].tolist()


def test_segments_and_damage():
    ids = np.arange(9000, dtype=np.int32) % 777
    body = token_files.pack([3, None, 9], np.array([0, 5000, 4000]), ids) + b"\n" + token_files.pack([], np.array([], np.int64), ids[:0]) + b"\n"
    parts = list(token_files.unpack(body))
    assert parts[0][0] == [3, None, 9]
    assert parts[0][1].tolist() == [0, 5000, 4000]
    assert (parts[0][2] == ids).all()
    for bad in (body[:50], b"nope" + body[4:], body[:-200], body[:900] + bytes([body[900] ^ 1]) + body[901:]):
        with pytest.raises(token_files.DamagedFile):
            list(token_files.unpack(bad))


def test_file_round_trip(spark):
    rows = [(i * 3 - 4, t, "", "", 1) for i, t in enumerate([*TEXTS, None, "the end " * 500])] + [(None, "no id", "", "", 1), (2, TEXTS[0], "", "", 1)]
    got = token_files.round_trip(frame(spark, rows), tokenizer_path(BYTE), 2).collect()
    lib, at = library(BYTE), 0
    want = {}
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    assert token_files.round_trip(frame(spark, []), tokenizer_path(BYTE), 2).count() == 0


def thue_morse(n):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", [WORD, BYTE])
@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_of_equal_structure_are_told_apart(name, n):
    texts = list(thue_morse(n))
    for method in ("speculate", "merge_synchronously"):
        ids, counts = memo(tokenizer_path(name), method).text_ids(texts)
        want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
        assert [ids[: counts[0]].tolist(), ids[counts[0] :].tolist()] == want


def test_words_that_share_a_hash(monkeypatch):
    """With a hash of three values every word is still compared with the one remembered."""
    from quillgraph.llm import bpe

    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, lengths: (np.asarray(lengths, np.uint64) % np.uint64(3)) << np.uint64(60))
    for name, method in ((WORD, "speculate"), (BYTE, "merge_synchronously")):
        v = Vocabulary(tokenizer_path(name))
        m = bpe.WordMemo(v, bpe.by_symbols(v, getattr(v, method)))
        texts = [*TEXTS, "x" * 40 + "y", "x" * 40 + "z", "x" * 40 + "y"]
        for _ in range(2):
            ids, counts = m.text_ids(texts)
            ends = np.cumsum(counts)
            for i, want in enumerate(library(name).encode_batch(texts, add_special_tokens=False)):
                assert ids[ends[i] - counts[i] : ends[i]].tolist() == want.ids


def test_span_hashes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 30_000, dtype=np.uint8)
    starts = rng.integers(0, 25_000, 4000)
    lengths = np.where(rng.random(4000) < 0.02, 3000, rng.integers(0, 40, 4000))
    from quillgraph.llm.shared import span_hashes

    h = span_hashes(data, starts, lengths)
    spans = [data[a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True)]
    assert len(set(spans)) == len(set(h.tolist())) == len(set(zip(spans, h.tolist(), strict=True)))
    alone = span_hashes(np.frombuffer(spans[5], np.uint8), np.zeros(1, np.int64), np.array([len(spans[5])]))
    assert alone[0] == h[5]
