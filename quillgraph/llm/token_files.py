"""Files of token ids, coded by the adaptive range coder in independent, checksummed blocks.

A file is a segment (a row of segments can be read too), followed by one newline byte. A segment, little-endian:

    magic b"QGTF", version u32, bytes of the whole segment u64, documents u64, ids u64, blocks u32, bits of an id u32
    documents: doc_id i64 each, then a byte each that is 1 for a null id, then ids u32 each
    blocks:    ids u32, bytes u32 and crc32 of the ids u32, each
    the blocks' codes, one after the other

The ids of a segment's documents lie in one stream, which is cut into blocks of BLOCK ids (below 2**19); a block's model and code depend on
no other block's. The crc32 is of the block's ids as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .bpe import memo
from .shared import bound_batches, materialise, scratch_path, text_slices

MAGIC, VERSION = b"QGTF", 1
_HEAD = struct.Struct("<4sIQQQII")
SEGMENT = range_coder.BLOCK * range_coder.LANES


class DamagedFile(ValueError):
    """A segment that is cut off, of another format, or whose ids don't match their checksum."""


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment."""
    block = range_coder.BLOCK
    n = -(-len(ids) // block)
    steps = min(block, len(ids))
    padded = np.zeros(n * block if n > 1 else steps, np.int32)
    padded[: len(ids)] = ids
    bits = max(1, int(ids.max(initial=0)).bit_length())
    codes = range_coder.encode(padded.reshape(n, steps).T, bits) if n else []
    raw = ids.astype("<u4")
    table = np.array([(len(raw[k : k + block]), len(c), zlib.crc32(raw[k : k + block].tobytes())) for k, c in zip(range(0, len(raw), block), codes, strict=True)], "<u4").reshape(-1, 3)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    body = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), sizes.astype("<u4").tobytes(), table.tobytes(), *codes]
    length = _HEAD.size + sum(map(len, body))
    return _HEAD.pack(MAGIC, VERSION, length, len(doc_ids), len(ids), n, bits) + b"".join(body)


def unpack(content: bytes, name: str = "") -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, their numbers of ids, and the ids of each segment of a file; raises DamagedFile."""
    view, at = memoryview(content), 0
    while at < len(view):
        if len(view) - at < _HEAD.size:
            raise DamagedFile(f"{name}: cut off at byte {at}")
        magic, version, length, docs, total, n, bits = _HEAD.unpack_from(view, at)
        if magic != MAGIC or version != VERSION:
            raise DamagedFile(f"{name}: not a token file at byte {at}")
        if at + length > len(view):
            raise DamagedFile(f"{name}: segment at byte {at} is cut off")
        p = at + _HEAD.size
        parts = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", 3 * n)):
            a = np.frombuffer(view, kind, count, p)
            parts.append(a)
            p += a.nbytes
        doc_ids, nulls, sizes, table = parts
        table = table.reshape(-1, 3).astype(np.int64)
        ends = p + np.cumsum(table[:, 1])
        codes = [bytes(view[e - s : e]) for e, s in zip(ends.tolist(), table[:, 1].tolist(), strict=True)]
        steps = int(table[:, 0].max(initial=0))
        ids = range_coder.decode(codes, steps, bits).T.reshape(-1)[:total] if n else np.empty(0, np.int32)
        raw, q = ids.astype("<u4"), 0
        for k, (size, _, crc) in enumerate(table.tolist()):
            if zlib.crc32(raw[q : q + size].tobytes()) != crc:
                raise DamagedFile(f"{name}: block {k} of the segment at byte {at} has a wrong checksum")
            q += size
        if q != total or int(sizes.sum()) != total:
            raise DamagedFile(f"{name}: the segment at byte {at} has a wrong index")
        yield [None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], sizes.astype(np.int64), ids
        at += length + 1


def write(df: DataFrame, path: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", method: str = "merge_synchronously") -> None:
    """Tokenize df's whole texts (null: empty), append end_id to each, and write files at path in ascending doc_id order.

    Each word that is not remembered is encoded by the method (see bpe.memo; "library" gives the same ids in more time). A file holds one
    segment of some SEGMENT ids (a longer text is in one segment); files follow each other by the two numbers in their names. Null
    doc_ids come first, rows of one doc_id are ordered by a hash of the text; repeated rows are written each. An empty df
    makes no segment; columns other than the two play no part.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = memo(tokenizer, method)
        end = [] if end_id is None else [end_id]
        held: tuple[list, list, list] = ([], [], [])

        def segment() -> pa.RecordBatch:
            out = pack(held[0], np.array(held[1], np.int64), np.concatenate(held[2]) if held[2] else np.empty(0, np.int32))
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["segment"])

        waiting = 0
        for b in text_slices(batches, "text"):
            ids, sizes = m.text_ids(b.column("text").to_pylist())
            if end:
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
            held[0].extend(b.column("doc_id").to_pylist())
            held[1].extend(sizes.tolist())
            held[2].append(ids)
            waiting += len(ids)
            if waiting >= SEGMENT - range_coder.LANES * 256:
                yield segment()
                waiting = 0
        if held[0]:
            yield segment()

    rows.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, file, place (ids of the file's documents before it), and ids array<int> of every document in the files at path.

    Files without a segment have no documents. digest: instead of the ids, n_tokens long and ids_crc32 long. Damaged files raise DamagedFile.
    """
    bound_batches(spark)  # a row is a file; batches are cut by bytes
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                place = 0
                for doc_ids, sizes, ids in unpack(content.as_buffer(), name):
                    ends = np.cumsum(sizes)
                    head = [pa.array(doc_ids, pa.int64()), pa.array([name] * len(doc_ids), pa.string()), pa.array(place + ends - sizes, pa.int64())]
                    if digest:
                        raw = ids.astype("<u4")
                        crc = [zlib.crc32(raw[e - s : e].tobytes()) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([*head, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))
                        yield pa.RecordBatch.from_arrays([*head, lists], names=["doc_id", "file", "place", "ids"])
                    place += int(ends[-1]) if len(ends) else 0

    return files.mapInArrow(run, "doc_id bigint, file string, place bigint, " + ("n_tokens bigint, ids_crc32 bigint" if digest else "ids array<int>"))


def round_trip(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write files for df (doc_id, text), read them back: doc_id, start, n_tokens and ids_crc32 of every document."""
    path = scratch_path(df.sparkSession, "token-files")
    write(df, path, tokenizer, end_id)
    docs = materialise(read(df.sparkSession, path, digest=True), "token-digests")
    # a row for each file
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = [F.regexp_extract("file", p, 1).cast("long") for p in (r"/part-(\d+)-[^/]*$", r"-c(\d+)[^/]*$")]
    before = F.sum("total").over(Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return docs.join(starts, "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
