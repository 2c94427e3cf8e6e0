"""BPE encoding and decoding by speculation and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import memo
from .shared import bound_batches, replaced, text_slices


def _encoded(batches: Iterator[pa.RecordBatch], path: str, text: str, ids: str, drop: set[str]) -> Iterator[pa.RecordBatch]:
    m = memo(path, "speculate")
    for b in text_slices(batches, text):
        flat, counts = m.text_ids(b.column(text).to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
        yield replaced(b, drop, **{ids: lists})


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    tokens = pa.array(memo(path, "speculate").v.strings, pa.string())
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // (1 << 20)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(a, b - a)
            lists = part.column(ids)
            offsets = pa.array(np.r_[0, np.cumsum(sizes[a:b])], pa.int64())
            words = pa.LargeListArray.from_arrays(offsets, pc.take(tokens, lists.flatten()).cast(pa.large_string()))
            out = pc.binary_join(words, pa.scalar(" ", pa.large_string()))
            if lists.null_count:
                out = pc.if_else(lists.is_valid(), out, None)
            yield replaced(part, **{text: out.cast(pa.string())})


def _schema(df: DataFrame, without: set[str], **more: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without and f.name not in more]
    return ", ".join(kept + [f"`{k}` {v}" for k, v in more.items()])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df without its text column, with `ids array<int>`: what the tokenizer file at `path` makes of the whole text.

    Null texts count as empty and get an empty array. A column of df named like `ids` is replaced. Row order, repeated
    rows and all other columns stay.
    """
    bound_batches(df.sparkSession)
    return df.mapInArrow(lambda it: _encoded(it, path, text, ids, {text}), _schema(df, {text}, **{ids: "array<int>"}))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with `text`: the tokens of `ids` joined by single spaces, special tokens included.

    That is the decoding of a tokenizer file without a decoder of its own. Null arrays give null, empty ones "".
    """
    bound_batches(df.sparkSession)
    return df.mapInArrow(lambda it: _decoded(it, path, ids, text), _schema(df, set(), **{text: "string"}))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and then decode(), in one pass of one Python worker."""
    bound_batches(df.sparkSession)
    schema = _schema(df, {text}, **{ids: "array<int>", decoded: "string"})
    return df.mapInArrow(lambda it: _decoded(_encoded(it, path, text, ids, {text, decoded}), path, ids, decoded), schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of df (doc_id, text)."""
    coded = round_trip(df.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
