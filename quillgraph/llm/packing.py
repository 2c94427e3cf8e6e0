"""Packing by optimal length buckets: boundaries from a dynamic program over the global histogram, batches of a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: Documents that are numbered together; a bucket is split into as many parts as that takes.
PART = 4096


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length ranges with the least padding, ascending; the last is the greatest length.

    lengths are distinct and ascending. Padding is the sum over documents of bound - length. Of equally good choices the one
    with fewer buckets, then the smaller bounds from the last bucket backwards, is taken.
    """
    n = len(lengths)
    if not n:
        return []
    length, documents = np.asarray(lengths, np.int64), np.r_[0, np.cumsum(counts)].astype(np.int64)
    tokens = np.r_[0, np.cumsum(np.asarray(lengths, np.int64) * counts)]
    # cost of one bucket over lengths[i:j]: length[j-1] * documents - tokens
    best = np.r_[0, length * documents[1:] - tokens[1:]]
    choices = []
    rounds = min(buckets, n)
    for _ in range(1, rounds):
        new, pick = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        # the costs are a Monge matrix, so the first best i never falls as j grows: halves are searched between their ends' choices
        spans = [(1, n, 0, n - 1)]
        while spans:
            a, z, low, high = spans.pop()
            j = (a + z) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            cost = best[i] + length[j - 1] * (documents[j] - documents[i]) - (tokens[j] - tokens[i])
            at = int(cost.argmin())
            pick[j], new[j] = low + at, cost[at]
            if a < j:
                spans.append((a, j - 1, low, low + at))
            if j < z:
                spans.append((j + 1, z, low + at, high))
        if new[n] >= best[n]:
            break
        choices.append(pick)
        best = new
    out, j = [], n
    for pick in reversed(choices):
        out.append(int(length[j - 1]))
        j = int(pick[j])
        if not j:
            return sorted(set(out))
    out.append(int(length[j - 1]))
    return sorted(set(out))


def pack(df: DataFrame, length: str = "n_tokens", doc_id: str = "doc_id", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """df with bucket (from 0), bucket_length (to which its documents are padded), batch and slot (place in the batch, from 0).

    A batch holds documents of one bucket, at most budget // bucket_length of them and one at least. batch numbers are
    unique over the result, not consecutive. Null lengths count as 0, and documents of length 0 are packed too. Within a
    part of a bucket (PART documents or so, by a hash of doc_id and of the row's place in df) documents are taken in order of
    doc_id, then of length; each part may end with a batch that is not full. Repeated rows each get a slot, and rows of one
    doc_id, null too, are dealt over the parts like others. df is best a written table, so that a row's place stays. An empty df gives no rows. Columns of df
    named like new ones are replaced.
    """
    spark = df.sparkSession
    df = df.drop("bucket", "bucket_length", "batch", "slot")
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    # a row for each different length: fewer than the root of twice the tokens of df
    cells = df.groupBy(n.alias("length")).agg(F.count("*").alias("documents")).orderBy("length").toPandas()
    lengths, counts = cells["length"].to_numpy(np.int64), cells["documents"].to_numpy(np.int64)
    bounds = boundaries(lengths, counts, buckets)
    fields = [("bucket", T.IntegerType()), ("bucket_length", T.LongType()), ("parts", T.IntegerType()), ("room", T.LongType())]
    rows, low = [], -1
    for i, b in enumerate(bounds):
        inside = int(counts[(lengths > low) & (lengths <= b)].sum())
        rows.append((i, b, max(1, round(inside / PART)), max(1, budget // max(1, b))))
        low = b
    table = spark.createDataFrame(rows, T.StructType([T.StructField(k, t) for k, t in fields]))
    which = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        which = F.when(n <= bounds[i], i).otherwise(which)
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("bucket", which.cast("int")).join(F.broadcast(table), "bucket")  # a row for each bucket
    placed = placed.withColumn("_part", F.pmod(F.xxhash64(F.col(doc_id), "_at"), F.col("parts")).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy(doc_id, n)) - 1
    placed = placed.withColumn("_place", place)
    number = F.floor(F.col("_place") / F.col("room"))
    batch = (F.col("bucket").cast("long") * (1 << 32) + F.col("_part")) * (1 << 20) + number
    return placed.select(*df.columns, "bucket", "bucket_length", batch.alias("batch"), (F.col("_place") % F.col("room")).cast("int").alias("slot"))
