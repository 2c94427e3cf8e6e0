"""Token counts by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import memo
from .shared import bound_batches, replaced, text_slices


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", keep_text: bool = False) -> DataFrame:
    """df with `out long`: how many tokens the whole text has under the tokenizer file at `path`.

    The text column is dropped unless keep_text. Null and empty texts have 0 tokens. Special strings inside a text are
    one token each. A column of df named like `out` is replaced; repeated rows and other columns stay.
    """
    bound_batches(df.sparkSession)
    drop = {out} if keep_text else {out, text}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop] + [f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = memo(path, "merge_synchronously")
        for b in text_slices(batches, text):
            yield replaced(b, drop, **{out: pa.array(m.text_counts(b.column(text).to_pylist()), pa.int64())})

    return df.mapInArrow(run, schema)


def limits(df: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of df (doc_id, text)."""
    sized = df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(sized, path).withColumn("over_limit", F.col("n_tokens") > limit)
