"""Batches of whole texts, and tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Python works on this many bytes of text at once (a longer text is one batch by itself).
BATCH_BYTES = 1 << 20


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts of any length pass through Python workers of bounded memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a session of one machine (as in tests) gets a temporary folder; on a cluster that is an error, as
    executors don't see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        root = getattr(scratch_root, "own", None)
        if root is None:
            root = scratch_root.own = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"


#: A write's shuffle files go when it ends: what follows reads the written table.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, columns stay prunable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise() wrote and nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches at document borders so that each holds about `limit` bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def replaced(batch: pa.RecordBatch, drop: Iterable[str] = (), **columns: pa.Array) -> pa.RecordBatch:
    """The batch without the dropped columns and with the given ones after the others."""
    gone = {*drop, *columns}
    keep = [i for i, n in enumerate(batch.schema.names) if n not in gone]
    names = [batch.schema.names[i] for i in keep] + list(columns)
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(columns.values()), names=names)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spans of more bytes are hashed one by one.
_LONG = 1024
#: By a number of bytes up to 8, the bits of so many first bytes.
HEADS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of the data on, and from its end, as numbers; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, 8 bytes after 8 bytes; equal spans have equal hashes wherever they lie."""
    q = eights(data)
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    h = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, left, own = starts, lengths, None
    if (lengths > _LONG).any():
        own = np.flatnonzero(lengths <= _LONG)
        at, left = starts[own], lengths[own]
        for i in np.flatnonzero(lengths > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    while len(at):
        some = q.take(at)
        some &= HEADS.take(left, mode="clip")
        if own is None:
            h = mix(h + mix(some))
        else:
            h[own] = mix(h[own] + mix(some))
        more = np.flatnonzero(left > 8)
        own = more if own is None else own[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the ragged pieces start..start+length, one after the other."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - ends + lengths, lengths)
    out += np.arange(len(out))
    return out
