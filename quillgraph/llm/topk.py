"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to whole numbers. The index of a block of rows holds bitmaps: bit b of attribute j of all its rows, of
the coarse value round(v / STEP) in two's complement. For a query the coarse values times its own are added up by bitmap
arithmetic: all bitmaps of one weight are added three by three. The k largest sums are found from the most significant slice downward, and all rows whose sum
comes near enough to the k-th that the exact score might be among the k best are scored exactly. Rows and queries with a value
of WIDE or more, whose sums might not fit a number, are scored exactly by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bound_batches, materialise

STEP = 16
#: Rows of a block and queries of a block. Long vectors lie in blocks of fewer rows: CELLS components, or LEAST_ROWS.
ROWS, QUERIES = 32_768, 256
CELLS, LEAST_ROWS = 1 << 21, 1_024
#: Tasks wanted at least, where there are so many pairs of blocks.
TASKS = 32
SCALE = 1024
WIDE = 1 << 24
#: Up to so many different lengths of vectors, a row for each of them is broadcast.
FEW_LENGTHS = 10_000


def _signed_digits(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights as sums of few powers of two: attributes, exponents and whether a power is taken off."""
    w = np.abs(weights)
    up, down = (3 * w & ~w) >> 1, (w & ~(3 * w)) >> 1
    at = np.arange(int((up | down).max(initial=0)).bit_length())
    sign, exponent, attribute = np.nonzero((np.stack([up, down])[:, None, :] >> at[:, None]) & 1)
    return attribute, exponent, (sign == 1) != (weights[attribute] < 0)


class BitSlices:
    """Bitmaps of a block of whole-number vectors (rows x attributes)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.n, self.attributes = values.shape
        self.coarse = (values + STEP // 2) // STEP
        self.width = max(2, int(np.abs(self.coarse).max(initial=0)).bit_length() + 1)
        words = self.words = -(-self.n // 64)
        padded = np.zeros((self.attributes, self.width, words * 8), np.uint8)
        for b in range(self.width):
            padded[:, b, : -(-self.n // 8)] = np.packbits(np.ascontiguousarray((self.coarse >> b & 1).astype(np.uint8).T), axis=1)
        slices = padded.view(np.uint64)
        # a value is the sum of these bits less 2 ** (width - 1); the second half, of complements, serves powers that are taken off
        slices[:, -1] = ~slices[:, -1]
        self.slices = np.concatenate([slices, ~slices]).reshape(-1, words)
        rest = values - self.coarse * STEP
        self.rest_norm, self.coarse_norm = np.sqrt((rest.astype(float) ** 2).sum(axis=1).max(initial=0)), np.sqrt((self.coarse.astype(float) ** 2).sum(axis=1).max(initial=0))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Slices (two's complement, least significant first) of the inner product of each row's coarse values with the weights."""
        most = int(np.abs(weights).sum()) << (self.width - 1)
        size = most.bit_length() + 2
        attribute, exponent, less = _signed_digits(weights)
        first = (attribute + less * self.attributes) * self.width
        half = 1 << self.width - 1
        constant = -sum(((half - 1 if n else half) << e) for e, n in zip(exponent.tolist(), less.tolist(), strict=True))
        total = np.zeros((size, self.words), np.uint64)
        carries = np.empty((0, self.words), np.uint64)
        for c in range(size):
            # all bitmaps of weight 2 ** c, three by three; what they carry goes to the next weight
            b = c - exponent
            own = (first + b)[(b >= 0) & (b < self.width)]
            one = constant >> c & 1
            rows = np.empty((len(own) + len(carries) + one, self.words), np.uint64)
            np.take(self.slices, own, axis=0, out=rows[: len(own)])
            rows[len(own) : len(rows) - one] = carries
            rows[len(rows) - one :] = ~np.uint64(0)
            carries, used = np.empty((max(0, len(rows) - 1), self.words), np.uint64), 0
            while len(rows) > 2:
                k = len(rows) // 3
                x, y, z = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                carry = carries[used : used + k]
                used += k
                np.bitwise_and(x, y, out=carry)
                x ^= y
                np.bitwise_and(x, z, out=y)
                carry |= y
                x ^= z
                left = len(rows) - 3 * k
                rows[k : k + left] = rows[3 * k :]
                rows = rows[: k + left]
            if len(rows) == 2:
                np.bitwise_and(rows[0], rows[1], out=carries[used])
                used += 1
                rows[0] ^= rows[1]
            carries = carries[:used]
            if len(rows):
                total[c] = rows[0]
        return total

    def at_least_kth(self, total: np.ndarray, k: int) -> np.ndarray:
        """A bitmap of the rows whose sum is at least the k-th largest (all, if there are fewer rows)."""
        valid = np.zeros(self.words * 8, np.uint8)
        valid[: -(-self.n // 8)] = np.packbits(np.ones(self.n, np.uint8))
        sure, maybe = np.zeros(self.words, np.uint64), valid.view(np.uint64)
        for b in range(len(total) - 1, -1, -1):
            one = ~total[b] if b == len(total) - 1 else total[b]  # the sign: 0 is the larger
            up = maybe & one
            count = int(np.bitwise_count(sure | up).sum())
            if count > k:
                maybe = up
            else:
                sure = sure | up
                maybe = maybe & ~one
                if count == k:
                    return sure
        return sure | maybe

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8))[: self.n])

    def values_of(self, total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The sums of some rows as numbers."""
        bits = total.view(np.uint8)[:, rows >> 3] >> (7 - (rows & 7)).astype(np.uint8) & 1
        weight = 1 << np.arange(len(total), dtype=np.int64)
        weight[-1] = -weight[-1]
        return weight @ bits.astype(np.int64)

    def at_least(self, total: np.ndarray, least: int) -> np.ndarray:
        """A bitmap of the rows whose sum is at least a number."""
        size = len(total)
        if least <= -(1 << size - 1):
            return np.packbits(np.ones(self.words * 64, np.uint8)).view(np.uint64)
        above, equal = np.zeros(self.words, np.uint64), np.full(self.words, ~np.uint64(0))
        for b in range(size - 1, -1, -1):
            one = ~total[b] if b == size - 1 else total[b]
            if (least >> b & 1) == (b != size - 1):  # a one, where the sign counts the other way
                equal = equal & one
            else:
                above = above | equal & one
                equal = equal & ~one
        return above | equal

    def best(self, query: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the k best for a whole-number query; `own` marks rows that don't count; ties to smaller ids."""
        want = k + int(own.sum())
        weights = (query + STEP // 2) // STEP
        total = self.sums(weights)
        sure = self.rows(self.at_least_kth(total, want))
        if len(sure) < self.n:
            kth = int(self.values_of(total, sure).min())
            # |score - STEP**2 * sum| <= |query| * |rest of v| + STEP * |rest of query| * |coarse v|, for both rows compared
            slack = np.linalg.norm(query.astype(float)) * self.rest_norm + STEP * np.linalg.norm((query - STEP * weights).astype(float)) * self.coarse_norm
            sure = self.rows(self.at_least(total, kth - int(np.ceil(2 * slack / STEP**2)) - 1))
        sure = sure[~own[sure]]
        exact = self.values[sure] @ query
        order = np.lexsort((ids[sure], -exact))[:k]
        return sure[order], exact[order]


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, of any size, as Python's whole numbers."""
    return np.array([[int(np.floor(v * scale)) if abs(v) < 2.0**1000 else int(v) * scale for v in row] for row in x.tolist()], object).reshape(x.shape)


class Block:
    """Rows of one length: the index of the usual ones, and the wide ones as they are."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        with np.errstate(over="ignore"):
            v = np.floor(x * SCALE)
        wide = (np.abs(v) >= WIDE).any(axis=1)
        self.ids, self.usual = ids, np.flatnonzero(~wide)
        self.slices = BitSlices(v[self.usual].astype(np.int64))
        self.usual_ids, self.wide_ids, self.wide = ids[self.usual], ids[wide], quantised(x[wide])
        self.x = x

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores of the k best rows of other vec_ids; a score beyond a long is the nearest long."""
        with np.errstate(over="ignore"):
            q = np.floor(query * SCALE)
        if (np.abs(q) >= WIDE).any():
            ids, scores = self.ids, quantised(self.x) @ quantised(query[None])[0]
        else:
            at, scores = self.slices.best(q.astype(np.int64), k, self.usual_ids == query_id, self.usual_ids)
            ids = self.usual_ids[at]
            if not len(self.wide_ids):
                return ids, scores
            ids, scores = np.r_[ids, self.wide_ids], np.r_[scores.astype(object), self.wide @ quantised(query[None])[0]]
        found = [(-max(-(1 << 63), min((1 << 63) - 1, int(s))), i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True) if i != query_id]
        found = sorted(found)[:k]
        return np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)


def taking_part(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, dims and x of the rows that have a vec_id and a vector of finite numbers."""
    x = F.col(embedding)
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return df.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.size(x).alias("dims"), x.alias("x"))


def _gathered(rows: DataFrame, key: str, total: int, kind: str) -> DataFrame:
    """A row for each (dims, key) of rows (dims, key, vec_id, x): ids and vectors as bytes, numbers as floats of that kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []

        def out() -> pa.RecordBatch:
            cols = [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([b"".join(ids)], pa.binary()), pa.array([b"".join(vectors)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["dims", key, "ids", "vectors"])

        for b in batches:
            dims, keys = np.asarray(b.column("dims")), np.asarray(b.column(key))
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(keys) != 0)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if now != (dims[start], keys[start]):
                    if now is not None:
                        yield out()
                    now, ids, vectors = (dims[start], keys[start]), [], []
                part = b.slice(start, end - start)
                ids.append(np.asarray(part.column("vec_id")).astype("<i8").tobytes())
                vectors.append(part.column("x").flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
        if now is not None:
            yield out()

    dealt = rows.repartition(total, "dims", key).sortWithinPartitions("dims", key)
    return dealt.mapInArrow(run, f"dims int, {key} bigint, ids binary, vectors binary")


def search(df: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query with all other rows.

    Queries are the rows whose vec_id is divisible by `every`; a row with the query's vec_id is no candidate of it. Components
    x become floor(SCALE * x), x as a double; a score beyond a long's range is the nearest long. Vectors that are null or hold
    null or non-finite numbers take no part; vectors of different length are not compared; empty vectors score 0. Ties go to
    the smaller vec_id; repeated rows are candidates each. Null vec_ids are neither queries nor candidates. An empty df gives
    no rows; other columns of df play no part.

    Each block of rows meets each block of queries of its length, as the search asks: rows go to their block, and the queries,
    which are fewer, to every block.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = taking_part(df, vec_id, embedding)
    # a row for each different length
    sizes = rows.groupBy("dims").agg(F.count("*").alias("rows"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries"))
    held = F.least(F.lit(ROWS), F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(CELLS) / F.greatest("dims", F.lit(1)))))
    sizes = sizes.select("dims", F.ceil(F.col("rows") / held).alias("blocks"), F.ceil(F.col("queries") / QUERIES).alias("groups"))
    sizes = materialise(sizes, "vector-sizes")
    lengths, blocks, groups = sizes.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("groups"), F.lit(0))).first()
    sizes = sizes.withColumn("parts", F.greatest(F.lit(1), F.least("groups", F.ceil(F.lit(TASKS) / F.col("blocks")))).cast("long"))
    known = rows.join(F.broadcast(sizes) if lengths <= FEW_LENGTHS else sizes, "dims")
    number = F.monotonically_increasing_id()
    # 32-bit floats stay as they are
    kind = "<f4" if rows.schema["x"].dataType.elementType.typeName() == "float" else "<f8"
    index = _gathered(known.withColumn("block", F.pmod(number, "blocks")).select("dims", "block", "vec_id", "x"), "block", max(1, blocks), kind)
    asked = _gathered(known.where(F.col("vec_id") % every == 0).withColumn("group", F.pmod(number, "groups")).select("dims", "group", "vec_id", "x"), "group", max(1, groups), kind)
    index, asked = materialise(index, "vector-blocks"), materialise(asked, "query-blocks")
    by_dims = F.broadcast(sizes) if lengths <= FEW_LENGTHS else sizes
    index = index.join(by_dims, "dims").select("dims", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "ids", "vectors")
    asked = asked.join(by_dims, "dims").select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod("group", "parts").alias("part"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    met = index.hint("merge").join(asked, ["dims", "block", "part"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["dims"], r["block"]) != last:
                    ids = np.frombuffer(r["ids"], "<i8")
                    block, last = Block(ids, np.frombuffer(r["vectors"], kind).astype(float).reshape(len(ids), r["dims"])), (r["dims"], r["block"])
                query_ids = np.frombuffer(r["query_ids"], "<i8")
                found: list[tuple] = []
                for q, x in zip(query_ids.tolist(), np.frombuffer(r["queries"], kind).astype(float).reshape(len(query_ids), r["dims"]), strict=True):
                    best, score = block.best(q, x, k)
                    found.append((np.full(len(best), q), best, score))
                cols = [pa.array(np.concatenate([f[i] for f in found]).astype(np.int64), pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    partial = materialise(met.mapInArrow(look, "query_id bigint, vec_id bigint, score bigint"), "block-best")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.select("query_id", best.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
