"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition, then word and prefix evidence is scored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialise, mix, replaced, span_hashes, text_slices

#: At most about this many labelled rows, chosen by a hash of their doc_id, fit the evidence.
SAMPLE = 50_000
#: Symbols of the character model: 0 is the end of a word, 1 to 26 are a to z, the rest share other letters.
SYMBOLS = 64

# What a character may stand for, besides itself.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "€": "e",
    "£": "l",
    "*": "aeiou",
    "#": "aeiou",
    "%": "aeiou",
}
SEPARATORS = " .-_*~'/,"
#: Costs, in nats: reading a sign as a letter, leaving it out, dropping a separator, cutting a run of letters.
READ, OMIT, JOIN, CUT = 0.5, 9.0, 0.2, 0.3
#: Costs of leaving a sign as it is: before a letter, at a span's end, and at its end where sentences have such signs too.
KEEP, KEEP_LAST, KEEP_MARK = 6.0, 4.0, 1.0
MARKS = "!|+(<*#%"

_LEET = re.escape("".join(STANDS_FOR))
_SEP = re.escape(SEPARATORS)
#: Single characters with separators between; a letter with signs inside; a run of letters and signs with one of each; three equal letters.
SPACED = rf"(?<![\w{_LEET}])(?:[^\W_][{_SEP}]{{1,2}}|[{_LEET}][{_SEP}]){{3,}}[^\W_](?![\w])"
MASKED = rf"[{_LEET}]*[^\W\d_]*(?:(?<=[^\W\d_])[{_LEET}.\-_]+|(?<![^\s])[{_LEET}]+)(?=[^\W\d_])[^\W_]+(?:[{_LEET}]+[^\W_]+)*[{_LEET}]*"
MIXED = rf"(?<![^\W_])(?<![{_LEET}])(?=[{_LEET}]*[^\W\d_])(?=[^\W\d_]*[{_LEET}])(?:[^\W_]|[{_LEET}])+"
LONG = r"[^\W_]*([^\W\d_])\1\1[^\W_]*"
SUSPICIOUS = re.compile(f"{SPACED}|{MASKED}|{MIXED}|{LONG}")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 if c.isalpha() else 0


#: Symbols of the characters below _PLANES; from there on up to _IDEOGRAPHS all are letters.
_PLANES, _IDEOGRAPHS = 0x20000, 0x323B0
_TABLE = np.zeros(_PLANES, np.uint8)
for _i in range(_PLANES):
    _c = chr(_i).lower()
    _TABLE[_i] = symbol(_c[0]) if _c else 0


def symbols(code: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    s = _TABLE[np.minimum(code, _PLANES - 1)]
    far = np.flatnonzero(code >= _PLANES)
    if len(far):
        s[far] = np.where(code[far] < _IDEOGRAPHS, 27 + code[far] % 37, 0)
    return s


_SIGN, _PART, _GAP = (np.array([chr(i) in x for i in range(0x3000)]) for x in (STANDS_FOR, [*STANDS_FOR, ".", "-", "_"], SEPARATORS))


def _flagged(texts: list[str]) -> dict[int, list[int]]:
    """Numbers of the lines of each text in which SUSPICIOUS may find something: signs beside letters, triple letters, single characters in a row."""
    joined = "\n\n\n\n".join([*texts, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code) - 4
    if n <= 0:
        return {}
    known = np.minimum(code, 0x2FFF)
    letter = symbols(code) > 0
    sign, part, gap = _SIGN[known], _PART[known], _GAP[known]
    mark = letter | ((code >= 48) & (code <= 57))
    single = mark | sign
    white = (code == 32) | ((code >= 9) & (code <= 13))
    at = [slice(k, n + k) for k in range(5)]
    before = np.r_[True, white[: n - 1]]
    hit = letter[at[0]] & (code[at[0]] == code[at[1]]) & (code[at[1]] == code[at[2]])
    # a letter, a run of parts of any length, then a letter or digit
    place = np.arange(len(code))
    after = np.minimum.accumulate(np.where(part, len(code) - 1, place)[::-1])[::-1]
    hit |= letter[at[0]] & part[at[1]] & mark[after[at[1]]]
    hit |= letter[at[0]] & sign[at[1]] | sign[at[0]] & letter[at[1]]
    hit |= before & sign[at[0]] & letter[after[at[0]]]
    hit |= np.r_[True, ~mark[: n - 1]] & single[at[0]] & gap[at[1]] & single[at[2]] & gap[at[3]] & single[at[4]]
    hit |= np.r_[True, ~mark[: n - 1]] & single[at[0]] & gap[at[1]] & gap[at[2]] & single[at[3]] & gap[at[4]]
    places = np.flatnonzero(hit)
    if not len(places):
        return {}
    breaks = np.flatnonzero(code == 10)
    ends = np.cumsum([len(t) + 4 for t in texts])
    owner = np.searchsorted(ends, places, "right")
    begin = (ends - [len(t) + 4 for t in texts])[owner]
    line = np.searchsorted(breaks, places) - np.searchsorted(breaks, begin)
    out: dict[int, list[int]] = {}
    for i, k in sorted(set(zip(owner.tolist(), line.tolist(), strict=True))):
        out.setdefault(i, []).append(k)
    return out


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of symbol trigrams, as SYMBOLS**3 cells; texts are set apart by word ends."""
    joined = "  ".join(["", *(t for t in texts if t), ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols(code).astype(np.int64)
    if len(s) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


class CharacterModel:
    """Costs of a symbol after two others."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        pair = c.sum(axis=0)
        low = (pair + 0.1) / (pair + 0.1).sum(axis=1, keepdims=True)
        total = c.sum(axis=2, keepdims=True)
        self.cost = -np.log((c + 5 * low[None]) / (total + 5)).astype(np.float32)
        self.cost = self.cost.reshape(-1).tolist()

    @staticmethod
    def options(s: str) -> list[list[tuple[str, float]]]:
        """The lattice of a span in lower case: for each character or run of a letter its readings and their costs."""
        last = len(s.rstrip("".join(STANDS_FOR)))
        spaced = sum(c in SEPARATORS for c in s) * 2 >= len(s) - 1
        out, i = [], 0
        while i < len(s):
            c, run = s[i], 1
            while c.isalpha() and i + run < len(s) and s[i + run] == c:
                run += 1
            if run > 2:
                options = [(c, CUT), (c + c, CUT)]
            elif c.isalpha():
                options, run = [(c, 0.0)], 1
            else:
                options, run = [(x, READ) for x in STANDS_FOR.get(c, "")], 1
                if c in STANDS_FOR:
                    options.append((c, KEEP if i < last else KEEP_MARK if c in MARKS else KEEP_LAST))
                if i >= last:
                    pass
                elif c in SEPARATORS:
                    options.append(("", JOIN))
                    if not (spaced and c != " "):
                        options.append((" ", JOIN))
                elif c in STANDS_FOR:
                    options += [("", OMIT), (" ", OMIT)]
                else:
                    options.append((" ", 0.0))
            out.append(options)
            i += run
        return out

    def read(self, a: int, b: int, letters: str) -> tuple[float, int, int]:
        """The cost of reading letters after the symbols a and b, and the last two symbols then."""
        cost = 0.0
        for ch in letters:
            z = symbol(ch)
            if ch in STANDS_FOR and not b:
                continue  # one end of a word, however many signs follow
            cost += self.cost[(a * SYMBOLS + b) * SYMBOLS + z]
            a, b = b, z
        return cost, a, b

    def end(self, a: int, b: int) -> float:
        return self.cost[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0

    def restore(self, span: str) -> str:
        """The cheapest reading of a suspicious span: Viterbi over its lattice, the states being the last two symbols."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.options(span.lower()):
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, out) in states.items():
                for letters, extra in options:
                    more, x, y = self.read(a, b, letters)
                    k = cost + extra + more
                    if (x, y) not in step or k < step[x, y][0]:
                        step[x, y] = (k, out + letters)
            states = step
        return min((cost + self.end(a, b), out) for (a, b), (cost, out) in states.items())[1]


class Restorer:
    """Texts with their suspicious spans restored; readings of short spans are remembered."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def _one(self, m: re.Match) -> str:
        span = m.group(0)
        if span not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            if len(span) > 400:
                return self.model.restore(span)
            self.known[span] = self.model.restore(span)
        return self.known[span]

    def __call__(self, texts: list[str | None]) -> list[str]:
        """Lower-case restored texts; only lines with something suspicious are searched."""
        out = [(t or "").lower() for t in texts]
        for i, line_starts in _flagged(out).items():
            lines = out[i].split("\n")
            for k in line_starts:
                lines[k] = SUSPICIOUS.sub(self._one, lines[k])
            out[i] = "\n".join(lines)
        return out


PREFIXES = (3, 4, 5, 6, 8)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and word prefixes of lower-case texts, the text of each, and the hash of its word; words are runs of letters and digits."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    letter = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.diff(np.r_[False, letter, False].astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.empty(0, np.int64)
    owner = np.searchsorted(ends, starts, "right")
    sizes = stops - starts
    whole = span_hashes(data, starts, sizes)
    keys, owners, words = [whole], [owner], [whole]
    for k in PREFIXES:
        at = np.flatnonzero(sizes > k)
        keys.append(mix(span_hashes(data, starts[at], np.full(len(at), k)) + np.uint64(k)))
        owners.append(owner[at])
        words.append(whole[at])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(words)


class Evidence:
    """For each feature, a lower bound of the share of toxic texts among those that hold it.

    Features with a bound of at least `strong` count. More toxic texts hold more features that fit them by chance, so the
    bound keeps a distance that grows with the logarithm of their number.
    """

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, base: float, n_toxic: int = 1, strong: float = 0.7):
        low = self.bound(toxic, clean, n_toxic)
        use = low > max(base, strong)
        order = np.argsort(keys[use])
        self.keys, self.low, self.base = keys[use][order], low[use][order], base

    @staticmethod
    def bound(toxic: np.ndarray, clean: np.ndarray, n_toxic: int) -> np.ndarray:
        z = max(1.2, 0.55 * np.log(max(1, n_toxic)) - 0.75)
        n = toxic + clean
        p = toxic / n
        return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    @classmethod
    def fewest(cls, n_toxic: int, strong: float = 0.7) -> int:
        """Toxic texts that must hold a feature for it to count, even if no clean one does."""
        t = 1
        while cls.bound(np.array([float(t)]), np.zeros(1), n_toxic)[0] <= strong:
            t += 1
        return t

    def score(self, texts: list[str]) -> np.ndarray:
        """1 less the product of (1 - evidence) of each text's different words, of each its strongest feature's; `base` where there is none."""
        doubt = np.ones(len(texts))
        keys, owner, word = features(texts)
        if len(self.keys) and len(keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == keys)
            order = hit[np.lexsort((-self.low[at[hit]], word[hit], owner[hit]))]
            first = np.r_[True, (np.diff(word[order].view(np.int64)) != 0) | (np.diff(owner[order]) != 0)] if len(order) else np.empty(0, bool)
            np.multiply.at(doubt, owner[order[first]], 1 - self.low[at[order[first]]])
        return np.maximum(1 - doubt, self.base)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit_characters(df: DataFrame, text: str) -> CharacterModel:
    """From all texts; SYMBOLS**3 cells at most come to the driver."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in text_slices(batches):
            total += trigram_counts(b.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    cells = df.select(F.col(text).alias("text")).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return CharacterModel(counts)


def labelled_sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    """text and toxic of about `limit` labelled rows that are not held out; equal texts with equal labels once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "toxic")
    share = min(1.0, limit / max(1, known.count()))
    ids = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # about `limit` ids and labels: 9 bytes each
    joined = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id").where("text is not null")
    return joined.select("text", (F.col("toxic") > 0).alias("toxic")).dropDuplicates()


def fit(df: DataFrame, labels: DataFrame, doc_id: str, text: str, characters: CharacterModel, limit: int = SAMPLE, least: int = 4) -> Evidence:
    """Evidence from the labelled sample: features of at least `least` toxic texts, and in how many clean ones they occur."""
    sample = materialise(labelled_sample(df, labels, doc_id, text, limit), "labelled")
    bound_batches(df.sparkSession)

    def counts(rows: DataFrame, wanted: np.ndarray | None) -> dict[int, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restore, found = Restorer(characters), []
            for b in text_slices(batches):
                keys, owner, _ = features(restore(b.column("text").to_pylist()))
                if wanted is not None:
                    hit = np.isin(keys, wanted)
                    keys, owner = keys[hit], owner[hit]
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                found.append(np.unique(keys[new], return_counts=True))
            if found:
                all_keys, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(all_keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        out = rows.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        # of the toxic texts only features that can count come to the driver
        return (out.where(F.col("n") >= max(least, Evidence.fewest(sizes.get(True, 0)))) if wanted is None else out).toArrow()

    sizes = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    base = min(0.5, (sizes.get(True, 0) + 0.5) / (sum(sizes.values()) + 1) / 2)
    toxic = counts(sample.where("toxic"), None)
    keys = toxic.column("key").to_numpy().view(np.uint64)
    if not len(keys):
        return Evidence(np.empty(0, np.uint64), np.empty(0), np.empty(0), base)
    order = np.argsort(keys)
    keys, t = keys[order], toxic.column("n").to_numpy()[order]
    clean = counts(sample.where("not toxic"), keys)
    c = np.zeros(len(keys))
    c[np.searchsorted(keys, clean.column("key").to_numpy().view(np.uint64))] = clean.column("n").to_numpy()
    return Evidence(keys, t.astype(float), c, base, sizes.get(True, 0))


def score(df: DataFrame, characters: CharacterModel, evidence: Evidence, text: str = "text", restored: bool = False) -> DataFrame:
    """df without its text, with score (0 to 1) and, if asked for, the restored lower-case text.

    Null and empty texts get the base score, which is below the share of toxic texts. Columns of df named like new ones are
    replaced; repeated rows stay.
    """
    bound_batches(df.sparkSession)
    new = {"score": "double"} | ({"restored": "string"} if restored else {})
    drop = {text, *new}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop] + [f"`{k}` {v}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(characters)
        for b in text_slices(batches, text):
            texts = restore(b.column(text).to_pylist())
            more = {"restored": pa.array(texts, pa.string())} if restored else {}
            yield replaced(b, drop, score=pa.array(evidence.score(texts), pa.float64()), **more)

    return df.mapInArrow(run, schema)


def judge(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """score() on df with models of df and of labels (doc_id, toxic) that are not held out, with held_out and predicted."""
    characters = fit_characters(df, text)
    evidence = fit(df, labels, doc_id, text, characters)
    out = score(df, characters, evidence, text)
    held = F.coalesce(is_held_out(F.col(doc_id)), F.lit(False))
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
