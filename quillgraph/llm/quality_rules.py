"""Quality rules: counts of each text, and the words that lines frequent across a host's documents leave of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, materialise, mix, replaced, span_hashes, text_slices
from .words import Words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _measure(column: pa.Array) -> dict[str, pa.Array]:
    w = Words(column)
    raw = w.hashes(lower=False)
    salt = mix(np.arange(1, w.n_docs + 1, dtype=np.uint64))

    at, h = w.windows(raw)
    again = np.flatnonzero(_repeated(h ^ salt[w.doc[at]]))
    covered = np.zeros(len(raw) + 2, bool)
    for k in range(3):
        covered[at[again] + k] = True

    doc, start, end, first = w.lines()
    own = span_hashes(w.data, start, end - start) ^ salt[doc]
    _, earliest = np.unique(own, return_index=True)
    lines, different = np.bincount(doc, minlength=w.n_docs), np.bincount(doc[earliest], minlength=w.n_docs)

    sizes = np.diff(np.r_[first, len(raw)])
    place = np.arange(len(raw)) - np.repeat(first, sizes)
    spread = mix(w.hashes(lower=True) + mix(place.astype(np.uint64)))
    normal = np.add.reduceat(spread, first) if len(first) else np.empty(0, np.uint64)
    offsets = pa.array(np.r_[0, np.cumsum(lines)], pa.int32())
    breaks = np.flatnonzero(w.data == 10)
    places = np.searchsorted(breaks, start) - np.searchsorted(breaks, w.offsets[doc])
    values = {
        "n_words": w.counts,
        "word_chars": w.per_doc(~w.white & ((w.data & 0xC0) != 0x80)),
        "n_symbols": w.per_doc(SYMBOL[w.data]),
        "n_dup_lines": lines - different,
        "n_repeat_words": np.bincount(w.doc[covered[: len(raw)]], minlength=w.n_docs),
    }
    return {k: pa.array(v.astype(np.int64), pa.int64()) for k, v in values.items()} | {
        "line_keys": pa.ListArray.from_arrays(offsets, pa.array(mix(normal).view(np.int64))),
        "line_words": pa.ListArray.from_arrays(offsets, pa.array(sizes.astype(np.int32))),
        "line_places": pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32))),
    }


def measure(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df without its text, with the counts of COUNTS, and key and words of each line that has words.

    With keep_text the text stays, and line_places has the number (from 0) of each such line among the \\n-split ones. Null and
    empty texts have zeros and no lines. Columns of df with a name of the new ones are replaced.
    """
    bound_batches(df.sparkSession)
    new = {c: "bigint" for c in COUNTS} | {"line_keys": "array<bigint>", "line_words": "array<int>"} | ({"line_places": "array<int>"} if keep_text else {})
    gone = [] if keep_text else [text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in {*gone, *new}] + [f"`{k}` {v}" for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            found = _measure(b.column(text))
            yield replaced(b, gone, **{k: found[k] for k in new})

    return df.mapInArrow(run, schema)


def judge(df: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", min_docs: int = 20, min_share: float = 0.01, keep_text: bool = False) -> DataFrame:
    """df without its text, with COUNTS, n_removed_words, base_failed and kept; with keep_text also its text less the lines removed.

    Lines are alike after lower-casing A-Z and with single spaces between their words. Lines that more than max(min_docs,
    min_share * documents of the host) documents of a host hold are removed; documents are told apart by doc_id, null being
    one. A document fails the base rules with fewer than 50 words or when over half its words stand in repeated 3-word windows;
    it is rejected too if the lines removed held over half its words.

    Null and empty texts have no words and fail. Rows with a null host form one host. Repeated rows get the same verdict.
    Columns of df with a name of the new ones are replaced. An empty df gives no rows.
    """
    extra = {*COUNTS, "line_keys", "line_words", "line_places", "_row", "_host", "_doc", "_gone", "n_removed_words", "base_failed", "kept"}
    base = df.select(*[c for c in df.columns if c not in extra], F.xxhash64(F.col(host)).alias("_host"), F.col(doc_id).alias("_doc"))
    measured = materialise(measure(base, text, keep_text).withColumn("_row", F.monotonically_increasing_id()), "quality")
    fields = {"line_keys": "key", "line_words": "words"} | ({"line_places": "place"} if keep_text else {})
    lines = measured.select("_host", "_doc", "_row", F.explode(F.arrays_zip(*fields)).alias("l")).select("_host", "_doc", "_row", *[F.col(f"l.{k}").alias(v) for k, v in fields.items()])
    often = lines.select("_host", "key", "_doc").distinct().groupBy("_host", "key").agg(F.count("*").alias("holders")).where(F.col("holders") > min_docs)
    hosts = measured.select("_host", "_doc").distinct().groupBy("_host").agg(F.count("*").alias("documents"))
    often = materialise(often.join(hosts, "_host").where(F.col("holders") > min_share * F.col("documents")).select("_host", "key"), "frequent-lines")
    totals = [F.sum("words").cast("long").alias("n_removed_words")] + ([F.collect_list("place").alias("_gone")] if keep_text else [])
    removed = lines.join(often, ["_host", "key"]).groupBy("_row").agg(*totals)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.drop("line_keys", "line_words", "line_places", "_doc", "_host").join(removed, "_row", "left").drop("_row")
    if keep_text:
        left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
        out = out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)).drop("_gone")
    out = out.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long"))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (2 * F.col("n_removed_words") <= F.col("n_words")))


#: The same in SQL over the table documents.
SQL = r"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text, source from documents),
wl as (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
base as (select d.r, d.doc_id, d.source, d.text, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as n_symbols from d join wl on d.r = wl.r),
pos as (select r, w, unnest(generate_series(1, len(w) - 2)) as i from wl where len(w) >= 3),
tri as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from pos),
dup as (select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from tri) where n > 1),
rep as (select r, count(distinct i + k) as n_repeat_words from dup, (select unnest([0, 1, 2]) as k) group by r),
ln as materialized (select r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
  array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as norm
  from (select r, unnest(string_split(text, chr(10))) as line from d)),
dl as (select r, count(*) - count(distinct line) as n_dup_lines from ln where words > 0 group by r),
hosts as (select source, count(distinct coalesce(doc_id::varchar, '')) as documents from d group by source),
often as (select d.source, norm from ln join d on d.r = ln.r join hosts h on h.source is not distinct from d.source
  where words > 0 group by d.source, norm, h.documents
  having count(distinct coalesce(d.doc_id::varchar, '')) > 20 and count(distinct coalesce(d.doc_id::varchar, '')) > 0.01 * h.documents),
gone as (select ln.r, sum(words) as removed from ln join d on d.r = ln.r join often o on o.source is not distinct from d.source and o.norm = ln.norm
  where words > 0 group by ln.r),
out as (select base.doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  coalesce(removed, 0)::bigint as n_removed_words
  from base left join rep on rep.r = base.r left join dl on dl.r = base.r left join gone on gone.r = base.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 2 * n_removed_words <= n_words as kept
from out
"""
