"""Languages of texts as mixtures: expectation-maximisation over word likelihoods, language set by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, replaced, text_slices

#: A model holds so many numbers for each language.
BUCKETS = 1 << 16
#: Log likelihoods of overlapping trigrams are scaled by TEMPER; each further language costs PENALTY * log(words). Proportions are
#: climbed until none moves by TOLERANCE, ROUNDS times at most.
TEMPER, PENALTY, FLOOR, TOLERANCE, ROUNDS = 0.5, 3.0, 1e-4, 1e-3, 60


class Grams:
    """Words (runs of letters, in lower case) of a batch of texts and the hashed byte trigrams that stand around each of their bytes."""

    def __init__(self, column: pa.Array):
        column = pc.utf8_lower(pc.fill_null(column, ""))
        column = pc.replace_substring_regex(column, r"[^\pL\pM]+", " ").cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
        # each text gets a blank before it, so that no trigram crosses texts
        offsets = offsets - offsets[0] + np.arange(n + 1)
        data = np.full(len(raw) + n + 1, 0x20, np.uint8)
        inside = np.ones(len(data), bool)
        inside[offsets] = False
        data[inside] = raw
        letter = data != 0x20
        self.at = np.flatnonzero(letter)
        wide = data.astype(np.uint32)
        mixed = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)
        self.grams = (mixed[self.at - 1] >> np.uint32(16)).astype(np.int64) if len(self.at) else np.empty(0, np.int64)
        self.words = np.flatnonzero(np.r_[True, np.diff(self.at) > 1]) if len(self.at) else np.empty(0, np.int64)
        self.doc_of_word = np.searchsorted(offsets, self.at[self.words], "right") - 1
        self.n_docs = n


def is_held_out(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


class Model:
    """Log likelihoods of trigrams (BUCKETS x languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def word_likelihoods(self, g: Grams) -> np.ndarray:
        out = np.empty((len(g.words), len(self.languages)))
        for k, row in enumerate(self.table):
            out[:, k] = np.add.reduceat(row[g.grams], g.words, dtype=np.float64) if len(g.words) else 0
        return out * TEMPER

    def mixtures(self, g: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of each language in each text of g that has words, and the numbers of those texts.

        Expectation-maximisation starts from all languages and, again and again, from those left when the one of the least
        proportion goes. Of these sets and of each single language the one of the best penalised likelihood is taken; of
        equally good ones the smaller set.
        """
        docs, first = np.unique(g.doc_of_word, return_index=True)
        if not len(docs):
            return np.empty((0, len(self.languages))), docs
        sizes = np.diff(np.r_[first, len(g.words)])
        ll = self.word_likelihoods(g)
        ll -= ll.max(axis=1, keepdims=True)
        p = np.exp(ll)
        k = p.shape[1]
        price = PENALTY * np.log(sizes + 1)
        part, gain = climb(p, first, sizes, np.full((len(docs), k), 1 / k))
        chosen, best, best_gain = np.ones(part.shape, bool), part, gain - price * (k - 1)
        every = np.arange(len(docs))
        for m in range(k - 1, 1, -1):
            chosen[every, np.where(chosen, part, np.inf).argmin(axis=1)] = False
            start = np.where(chosen, part + FLOOR, 0)
            part, gain = climb(p, first, sizes, start / start.sum(axis=1, keepdims=True))
            gain = gain - price * (m - 1)
            better = gain >= best_gain
            best, best_gain = np.where(better[:, None], part, best), np.where(better, gain, best_gain)
        alone = np.add.reduceat(ll, first, axis=0)
        one = alone.argmax(axis=1)
        better = alone[every, one] >= best_gain
        best = best.copy()
        best[better] = 0
        best[every[better], one[better]] = 1
        return best, docs


def climb(p: np.ndarray, first: np.ndarray, sizes: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text by expectation-maximisation from pi, and their log likelihood.

    p: likelihoods of all words by language; words of a text stand together, from `first` on, `sizes` of them.
    """
    pi = pi.copy()
    live, own_p, own_first = np.arange(len(first)), p, first
    for _ in range(ROUNDS):
        n = sizes[live]
        r = own_p * np.repeat(pi[live], n, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(r, own_first, axis=0) / n[:, None]
        moving = np.abs(new - pi[live]).max(axis=1) >= TOLERANCE
        pi[live] = new
        if not moving.any():
            break
        if 2 * n[moving].sum() < n.sum():  # go on with the texts that still move
            own_p = own_p[np.repeat(moving, n)]
            live = live[moving]
            own_first = np.cumsum(sizes[live]) - sizes[live]
    mix = np.maximum((p * np.repeat(pi, sizes, axis=0)).sum(axis=1), 1e-300)
    return pi, np.add.reduceat(np.log(mix), first)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Trigram counts of every text with a language, however many there are; None if there is no language."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    bound_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        index = pa.array(languages)
        for b in text_slices(batches):
            g = Grams(b.column("text"))
            code = pc.index_in(b.column("lang"), index).to_numpy(zero_copy_only=False).astype(np.int64)
            per_word = np.diff(np.r_[g.words, len(g.grams)])
            total += np.bincount(np.repeat(code[g.doc_of_word], per_word) * BUCKETS + g.grams, minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["cell", "n"])

    # at most BUCKETS rows for each language
    cells = known.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return Model(languages, counts.reshape(len(languages), BUCKETS))


def predict(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with lang_pred, score and lang_mix (language -> proportion, of the chosen set).

    score is the proportion of lang_pred. Texts that are null or have no letter, and all texts without a model, get "und",
    0.0 and an empty map. Equal proportions go to the language that sorts first. The text is dropped unless keep_text;
    columns of df named like new ones are replaced; repeated rows stay.
    """
    bound_batches(df.sparkSession)
    new = {"lang_pred": "string", "score": "double", "lang_mix": "map<string,double>"}
    drop = {*new} if keep_text else {text, *new}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop] + [f"`{k}` {v}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            n = b.num_rows
            names, score, mixes = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            if model is not None:
                lettered = pc.fill_null(pc.match_substring_regex(b.column(text), r"\pL"), False).to_pylist()
                pi, docs = model.mixtures(Grams(b.column(text)))
                for row, d in zip(pi, docs.tolist(), strict=True):
                    if lettered[d]:
                        k = int(row.argmax())
                        names[d], score[d] = model.languages[k], min(1.0, row[k])
                        mixes[d] = [(model.languages[j], float(row[j])) for j in np.flatnonzero(row > 1e-3)]
            yield replaced(b, drop, lang_pred=pa.array(names, pa.string()), score=pa.array(score, pa.float64()), lang_mix=pa.array(mixes, pa.map_(pa.string(), pa.float64())))

    return df.mapInArrow(run, schema)


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep_text: bool = False) -> DataFrame:
    """predict() on df with a model of df's rows whose crc32(doc_id as text) mod 5 is not 0, and held_out: the others."""
    out = F.coalesce(is_held_out(F.col(doc_id)), F.lit(False))
    model = fit(df.where(~out), text, lang)
    return predict(df, model, text, keep_text).withColumn("held_out", out)
