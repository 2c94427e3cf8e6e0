"""MinHash near-duplicates with odd sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import bucket_components
from .shared import bound_batches, discard, materialise, mix, replaced, text_slices
from .words import Words

#: Rows of a band, and bands. A pair of similarity 0.85 shares none with probability (1 - 0.85**5)**36 < 1e-9.
ROWS, BANDS = 5, 36
SAMPLES = ROWS * BANDS
#: Bits of an odd sketch, as 16 longs.
BITS = 1024
#: Bits of the odd sketch of a whole set.
PARITY = 2048
_rng = np.random.default_rng(11)
MULTIPLIERS = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_MULTIPLY, _ADD = (MULTIPLIERS >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (OFFSETS >> np.uint64(31)).astype(np.uint32)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima of each set, none of them empty, over the upper 32 bits of its hashes.

    Equal shingles have equal samples, as with 64 bits; different ones that agree in 32 bits can only add candidates.
    """
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), SAMPLES), np.uint64)
    buffer = np.empty_like(flat)
    for i in range(SAMPLES):
        np.multiply(flat, _MULTIPLY[i], out=buffer)
        buffer += _ADD[i]
        out[:, i] = np.minimum.reduceat(buffer, starts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A key of each band of each set."""
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(minima), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h + minima[:, r::ROWS])
    return h


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample (its number and value) flips one of BITS bits. 16 longs a set."""
    n = len(minima)
    at = (mix(minima + np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    at += np.arange(n)[:, None] * BITS
    odd = (np.bincount(at.ravel(), minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, BITS // 64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches of whole sets (not empty): every shingle flips one of PARITY bits.

    The XOR of two has no more bits than shingles that are in one set only; of links those are at most
    (1 - similarity) / (1 + similarity) of both sizes' sum, so more bits rule a link out for certain.
    """
    owner = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    at = (np.concatenate(sets) >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64) + owner * PARITY
    odd = (np.bincount(at, minlength=len(sets) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(sets), PARITY // 64)


def _columns(name: str, bits: int) -> list[Column]:
    """The longs of a sketch as columns that are never null.

    The JVM compiles no method of more than 8,000 bytes of bytecode; a join's condition on arrays, or on columns that may be
    null, is longer than that and then runs interpreted, ten times slower.
    """
    return [F.coalesce(F.get(name, F.lit(i)), F.lit(0)).alias(f"{name}{i}") for i in range(bits // 64)]


def _differing(x: str, y: str, name: str, bits: int) -> Column:
    return sum((F.bit_count(F.col(f"{x}.{name}{i}").bitwiseXOR(F.col(f"{y}.{name}{i}"))) for i in range(bits // 64)), F.lit(0))


def difference_limit(similarity: float) -> int:
    """Popcount of the XOR of two sketches that sets of at least this similarity exceed with probability below 1e-9.

    Each of the SAMPLES samples differs with probability 1 - similarity and then flips two bits at most; six standard
    deviations are added.
    """
    p = 1 - similarity
    return int(2 * (SAMPLES * p + 6.2 * np.sqrt(SAMPLES * p * similarity)) + 1)


def _sets(column: pa.Array, size: int) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    import xxhash

    sets = Words(column).shingle_sets(size)
    keys = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets]
    return sets, keys


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _lists(values: np.ndarray, filled: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(np.where(filled, values.shape[1], 0))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64).ravel(), pa.int64()))


def signatures(df: DataFrame, text: str, size: int) -> DataFrame:
    """df (without columns named like the new ones) without its text, with n_shingles, set_hi, set_lo, bands, sketch and parity; no shingles: empty lists."""
    bound_batches(df.sparkSession)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + ["n_shingles bigint", "set_hi bigint", "set_lo bigint", "bands array<bigint>", "sketch array<bigint>", "parity array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            sets, keys = _sets(b.column(text), size)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = [s for s in sets if len(s)]
            minima = min_hashes(full) if full else np.empty((0, SAMPLES), np.uint64)
            new = {"n_shingles": pa.array(sizes, pa.int64()), "set_hi": _signed([k[0] for k in keys]), "set_lo": _signed([k[1] for k in keys])}
            yield replaced(b, [text], **new, bands=_lists(band_keys(minima), sizes > 0), sketch=_lists(odd_sketches(minima), sizes > 0), parity=_lists(parities(full) if full else np.empty((0, PARITY // 64), np.int64), sizes > 0))

    return df.mapInArrow(run, schema)


#: The bitmap of the texts wanted later has so many rows of 64 bits at most, whatever the input.
SLOTS = 1 << 17


def sifted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of texts whose `key` (a long) wanted holds, and some others: a bitmap is broadcast, so other texts leave the scan neither for Python nor for a shuffle."""
    slot, bit = F.pmod("key", F.lit(SLOTS)).alias("_slot"), F.shiftrightunsigned("key", 58).cast("int")
    sieve = wanted.select(slot, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    held = texts.select("*", slot, bit.alias("_bit")).join(F.broadcast(sieve), "_slot")
    return held.where(F.getbit("_bits", F.col("_bit")) == 1).select(*texts.columns)


def shingles(df: DataFrame, text: str, size: int) -> DataFrame:
    """set_hi, set_lo and the sorted shingle hashes of df's texts."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            sets, keys = _sets(b.column(text), size)
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([_signed([k[0] for k in keys]), _signed([k[1] for k in keys]), lists], names=["set_hi", "set_lo", "shingles"])

    return df.select(text).mapInArrow(run, "set_hi bigint, set_lo bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """a and b of the pairs (a, b, sa, sb) whose full sets, each without repeats, are similar enough."""
    bound_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, ax), (y, ay) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("sa"), batch.column("sb")))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                z = np.concatenate([x[ax[i] : ax[i + 1]], y[ay[i] : ay[i + 1]]])
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                keep[i] = 100 * both >= percent * (len(z) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """df without its text, with n_shingles, component_id and kept.

    A text's set holds its distinct shingles of `size` words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased); with fewer words the
    whole sequence is one shingle; without words the set is empty and linked with nothing. Sets with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable over links, and kept
    says whether it is the row's own. Equal sets are one node. Links are found by banded MinHash, held against odd sketches
    of MinHash samples and of whole sets, and confirmed on full sets; sets are compared by 64-bit hashes of their shingles.

    Null texts count as empty. Rows that share a doc_id and a text share all results; a null doc_id never becomes a
    component_id unless all of the component are null, and then kept is true. Columns of df named like new ones are replaced.
    """
    new = {"n_shingles", "component_id", "kept", "set_hi", "set_lo", "bands", "sketch", "parity", "_row", "_text"}
    base = df.select(*[c for c in df.columns if c not in new], F.xxhash64(text).alias("_text"))
    rows = materialise(signatures(base, text, size).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    key = ["set_hi", "set_lo"]
    classes = rows.where("n_shingles > 0").groupBy(*key).agg(F.min("_row").alias("node"), F.min(doc_id).alias("least_id"))
    classes = materialise(classes, "classes")
    first = rows.join(classes.select("node"), F.col("_row") == F.col("node"))
    first = materialise(first.select("node", "n_shingles", "set_hi", "set_lo", "_text", F.col(doc_id).alias("_id"), "sketch", "parity", "bands"), "class-signatures")
    nodes = first.select("node", F.col("n_shingles").alias("n"), *_columns("sketch", BITS), *_columns("parity", PARITY))
    most = difference_limit(percent / 100)

    def near(x: str, y: str) -> Column:
        a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (_differing(x, y, "sketch", BITS) <= most) & ((100 + percent) * _differing(x, y, "parity", PARITY) <= (100 - percent) * (a + b))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "candidates")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = materialise(first.join(wanted, "node").select("node", "_text", "_id", *key), "candidate-nodes")
        texts = df.select(F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.xxhash64(text)).alias("key"))
        texts = sifted(texts, wanted.select(F.xxhash64("_id", "_text").alias("key")))
        sets = shingles(texts, "text", size).dropDuplicates(key).join(wanted.select("node", *key), key).select("node", "shingles")
        sets = materialise(sets, "candidate-sets")
        y, x = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ba")
        held = pairs.join(y, "b").join(x, "a")
        links = materialise(confirmed(held, percent), "set-links")
        discard(pairs, wanted, sets)
        return links

    buckets = first.select("node", F.explode("bands").alias("bucket")).select("bucket", "node")
    roots = bucket_components(buckets, nodes, near, verify)
    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = materialise(grouped.join(least, "root").select(*key, "component_id"), "labels")
    discard(classes, first, roots)
    plain = [c for c in rows.columns if c not in {*key, "bands", "sketch", "parity", "_row", "_text"}]
    # an empty set is its own component; equal sets lie in one
    out = rows.select(*plain, *key).join(labels.withColumn("_found", F.lit(True)), key, "left")
    component = F.when(F.col("_found"), F.col("component_id")).otherwise(F.col(doc_id))
    return out.withColumn("component_id", component).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id"))).select(*plain, "component_id", "kept")
