"""Fuzzy line deduplication by SimHash, in DataFrame functions only.

A word votes in one class only, chosen by its hash, so the SimHash is a row of CLASSES symbols of BITS bits, and a changed word
touches two symbols at most: the old word's and the new one's. Lines whose SimHashes differ in at most DISTANCE symbols agree on
BLOCKS - DISTANCE of BLOCKS blocks of symbols and meet in the bucket of that choice of blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import bucket_components
from .shared import discard, materialise

CLASSES, BITS, BLOCKS, DISTANCE = 20, 5, 5, 2
#: Symbols in a number; a SimHash is two numbers, lo and hi. Bit j of symbol k is bit LANE * j + k % HALF.
HALF = CLASSES // 2
#: A class's sums lie in one number, LANE bits each: the weight of its words, then of those with each bit set.
LANE = 10
_ONES = sum(1 << LANE * j for j in range(BITS))
_MOST = (1 << LANE - 1) - 1
#: Two lines of more characters are compared by words, in pieces of PIECE words.
LONG, PIECE = 256, 512
#: A sieve of places has so many slots of 64 bits at most, whatever the input.
SLOTS = 1 << 19
#: Words that vote in one row.
GROUP = 8
_ANSI = "spark.sql.ansi.enabled"


def normalised(line: Column) -> Column:
    """The words of a line in lower case: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def _split(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _text, line and raw of each \\n-split line. A text is hashed before it is split, once and not for each of its lines."""
    whole = df.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_text"), F.col(text).alias("_whole"))
    return whole.select("_id", "_text", F.posexplode(F.split("_whole", "\n")).alias("line", "raw"))


def lines_of(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _text (a hash of the text), line (from 0) and words of each \\n-split line that has a letter or digit."""
    return _split(df, doc_id, text).where(F.col("raw").rlike(r"[\p{L}\p{N}]")).select("_id", "_text", "line", normalised(F.col("raw")).alias("words"))


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def sim_hashes(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, lo and hi of lines (key, words): CLASSES symbols of BITS bits, HALF of them in each number.

    A word weighs by its letters beyond two (1 to 4), as lines of one language share their short words; a bit of a symbol is
    set if more than half the weight in its class has it. Beyond a weight of _MOST in a class (lines of some 2,500 words) its
    sums run into each other; the symbol still depends on the words of its class alone. GROUP words are added up in one row, so
    that a line's sums are looked up once for them.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(GROUP))
    groups = lines.select(*key, "words", F.explode(starts).alias("_at"))
    groups = groups.select(*key, *[F.get("words", F.col("_at") + j).alias(f"_w{j}") for j in range(GROUP)]).where(F.col("_w0").isNotNull())
    votes = []
    for j in range(GROUP):
        w = F.col(f"_w{j}")
        h = F.xxhash64(w)
        weight = F.when(w.isNull(), 0).otherwise(F.greatest(F.least(F.length(w) - 2, F.lit(4)), F.lit(1))).cast("long")
        votes += [F.pmod(h, F.lit(CLASSES)).cast("int").alias(f"_c{j}"), ((h.bitwiseAND(F.lit(_ONES << LANE)) + 1) * weight).alias(f"_v{j}")]
    words = groups.select(*key, *votes)
    zero = F.lit(0).cast("long")

    def cast_in(k: int) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.col(f"_c{j}") == k, F.col(f"_v{j}")).otherwise(zero) for j in range(GROUP)])

    def symbol(k: int) -> Column:
        # _MOST + 2 * ones - weight, in all lanes at once: its highest bit says whether ones are more than half
        v = F.col(f"v{k}")
        lanes = 2 * F.shiftrightunsigned(v, LANE) + (_MOST - v.bitwiseAND(F.lit((1 << LANE) - 1))) * _ONES
        return F.shiftleft(F.shiftrightunsigned(lanes, LANE - 1).bitwiseAND(F.lit(_ONES)), k % HALF)

    session = lines.sparkSession
    before = session.conf.get(_ANSI)
    # the sums of the longest lines wrap around; sums that look for that (try_sum) took a quarter of this function's time
    session.conf.set(_ANSI, "false")
    try:
        counted = words.groupBy(*key).agg(*[F.sum(cast_in(k)).alias(f"v{k}") for k in range(CLASSES)])
        return counted.select(*key, _or([symbol(k) for k in range(HALF)]).alias("lo"), _or([symbol(k) for k in range(HALF, CLASSES)]).alias("hi"))
    finally:
        session.conf.set(_ANSI, before)


def _masks(symbols: set[int]) -> list[Column]:
    """The bits of these symbols in lo and hi."""
    return [F.lit(sum(_ONES << k % HALF for k in symbols if k // HALF == side)).cast("long") for side in (0, 1)]


_EDGES = [CLASSES * i // BLOCKS for i in range(BLOCKS + 1)]
#: The symbols in which the members of each of a line's buckets may differ.
OPEN = [sorted(k for b in left for k in range(_EDGES[b], _EDGES[b + 1])) for left in combinations(range(BLOCKS), DISTANCE)]


def sim_blocks() -> list[Column]:
    """A key for each choice of BLOCKS - DISTANCE blocks of lo and hi."""
    keys = []
    for n, left in enumerate(OPEN):
        lo, hi = _masks(set(range(CLASSES)) - set(left))
        keys.append(F.xxhash64(F.lit(n), F.col("lo").bitwiseAND(lo), F.col("hi").bitwiseAND(hi)))
    return keys


def divided(members: DataFrame) -> DataFrame:
    """members (bucket, node, lo, hi, ...) of large buckets in smaller ones, by some of their open symbols.

    The open symbols fall into DISTANCE + 2 parts, of which any two members of at most DISTANCE different symbols agree on
    two; the members of a new bucket agree on a choice of two.
    """
    ways = []
    for left in OPEN:
        parts = [set(left[i :: DISTANCE + 2]) for i in range(DISTANCE + 2)]
        ways.append(F.array(*[F.array(*_masks(a | b)) for a, b in combinations(parts, 2)]))
    way = F.array_position(F.array(*sim_blocks()), F.col("bucket")).cast("int")
    parts = members.select("*", F.posexplode(F.element_at(F.array(*ways), way)).alias("_n", "_mask"))
    key = F.xxhash64("bucket", "_n", F.col("lo").bitwiseAND(F.col("_mask")[0]), F.col("hi").bitwiseAND(F.col("_mask")[1]))
    return parts.withColumn("bucket", key).drop("_n", "_mask")


def symbols_apart(x: str, y: str) -> Column:
    """In how many symbols the SimHashes of frames x and y differ."""
    z = [F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in ("lo", "hi")]
    return sum((F.bit_count(_or([F.shiftrightunsigned(h, LANE * j) for j in range(BITS)]).bitwiseAND(F.lit((1 << HALF) - 1))) for h in z), F.lit(0))


def coded(words: Column) -> Column:
    """A character for each word, one of 20,000 by its hash."""
    one = lambda w: F.decode(F.unhex(F.hex(F.pmod(F.xxhash64(w), F.lit(20_000)) + 0x4E00)), "UTF-16BE")
    return F.array_join(F.transform(words, one), "")


def similar(x: str, y: str, similarity: float) -> Column:
    """Whether the edit distance of two lines (frames x and y of norm and words) is at most (1 - similarity) * length of the longer.

    norm is the line's words joined by spaces, null if that is longer than LONG; words has a character for each word. Where a
    norm is null the distance is that of words: the sum over pieces of PIECE words each, which is never less than the distance
    of the whole lines and takes time in proportion to their length.
    """
    x_norm, y_norm = F.col(f"{x}.norm"), F.col(f"{y}.norm")
    allowed = F.floor((1 - similarity) * F.greatest(F.length(x_norm), F.length(y_norm)) + 1e-9).cast("int")
    # -1 beyond the allowed distance; only a band of that width is computed
    by_characters = F.call_function("levenshtein", x_norm, y_norm, allowed) >= 0
    a, b = F.col(f"{x}.words"), F.col(f"{y}.words")
    longer = F.greatest(F.length(a), F.length(b))
    starts = F.sequence(F.lit(0), F.floor((longer - 1) / PIECE).cast("int"))
    apart = F.aggregate(starts, F.lit(0), lambda d, i: d + F.levenshtein(F.substr(a, i * PIECE + 1, F.lit(PIECE)), F.substr(b, i * PIECE + 1, F.lit(PIECE))))
    return F.when(x_norm.isNotNull() & y_norm.isNotNull(), by_characters).otherwise(apart <= F.floor((1 - similarity) * longer + 1e-9))


def lines_at(df: DataFrame, doc_id: str, text: str, places: DataFrame) -> DataFrame:
    """_id, _text, line and raw of the \\n-split lines of df at these places (_id, _text, line), and of some others.

    A bitmap of the places' hashes, of SLOTS rows at most, is broadcast: only lines it may hold are shuffled later, no whole texts.
    """
    place = F.xxhash64("_id", "_text", "line")
    slot, bit = F.pmod(place, F.lit(SLOTS)).alias("_slot"), F.shiftrightunsigned(place, 58).cast("int")
    sieve = places.select(slot, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    held = _split(df, doc_id, text).select("*", slot, bit.alias("_bit")).join(F.broadcast(sieve), "_slot")
    return held.where(F.getbit("_bits", F.col("_bit")) == 1).select("_id", "_text", "line", "raw")


def _groups(df: DataFrame, doc_id: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Occurrences (_id, _text, line, k1, k2, ...), and k1, k2, group_id, first_at and alone (nothing repeats it) of different lines."""
    taking = lines_of(df, doc_id, text)
    key = ["k1", "k2"]
    norm = taking.select("_id", "_text", "line", "words", F.array_join("words", " ").alias("_norm"))
    keyed = norm.select("_id", "_text", "line", F.xxhash64("_norm").alias("k1"), F.xxhash64(F.lit(1), "_norm").alias("k2"), F.length("_norm").alias("chars"), "words")
    # rows equal in doc_id and text count their words together, which leaves the SimHash as it is
    occurrences = materialise(sim_hashes(keyed, ["_id", "_text", "line", *key, "chars"]), "lines")
    distinct = occurrences.groupBy(*key).agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("chars").alias("chars"), F.min(F.struct("_id", "_text", "line")).alias("at"), F.count("*").alias("copies"))
    distinct = materialise(distinct.select("*", F.monotonically_increasing_id().alias("node")), "different-lines")
    nodes = distinct.select("node", "lo", "hi", "chars")

    def near(x: str, y: str) -> Column:
        a, b = F.col(f"{x}.chars"), F.col(f"{y}.chars")
        return (symbols_apart(x, y) <= DISTANCE) & (F.least(a, b) >= similarity * F.greatest(a, b))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "line-pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # the wanted lines, cut from the first document that holds them
        places = materialise(distinct.join(wanted, "node").select("node", "chars", "at.*"), "line-places")
        at = lines_at(df, doc_id, text, places).alias("t").join(places.alias("p"), F.col("t._id").eqNullSafe(F.col("p._id")) & (F.col("t._text") == F.col("p._text")) & (F.col("t.line") == F.col("p.line")))
        cut = at.select("node", "chars", normalised(F.col("raw")).alias("words"))
        # lines too short to be near one of more than LONG characters are compared by characters only
        by_words = F.when(F.col("chars") > similarity * LONG, coded(F.col("words")))
        cut = cut.select("node", F.when(F.col("chars") <= LONG, F.array_join("words", " ")).alias("norm"), by_words.alias("words"))
        texts = materialise(cut.dropDuplicates(["node"]), "line-texts")
        held = pairs.join(texts.alias("y"), F.col("b") == F.col("y.node")).join(texts.alias("x"), F.col("a") == F.col("x.node"))
        links = materialise(held.where(similar("x", "y", similarity)).select("a", "b"), "line-links")
        discard(pairs, places, texts)
        return links

    buckets = nodes.select("node", F.explode(F.array(*sim_blocks())).alias("bucket")).select("bucket", "node")
    roots = bucket_components(buckets, nodes, near, verify, divided)
    grouped = distinct.select(*key, "node", "at", "copies").join(roots, "node", "left")
    grouped = grouped.select(*key, F.coalesce("root", "node").alias("group_id"), "at", (F.col("root").isNull() & (F.col("copies") == 1)).alias("alone"), F.col("root").isNotNull().alias("linked"))
    # a line that is linked with no other is its group's first
    firsts = grouped.where("linked").groupBy("group_id").agg(F.min("at").alias("first_at"))
    labels = grouped.join(firsts, "group_id", "left").select(*key, "group_id", F.coalesce("first_at", "at").alias("first_at"), "alone")
    labels = materialise(labels, "line-groups")
    discard(distinct, roots)
    return occurrences, labels


def duplicate_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """_id, _text, line, group_id of every line with a letter or digit, and first: whether it is the one its group keeps.

    Lines of equal words belong together, and so do lines whose SimHashes differ in at most DISTANCE symbols and that are
    similar() enough; groups are the connected components of that. The first line of a group by (doc_id,
    line, hash of the text) is kept; null doc_ids come first. Rows equal in doc_id and text are one occurrence. Null and
    empty texts, and an empty df, have no lines. Extra columns of df, whatever their names, play no part.
    """
    occurrences, labels = _groups(df, doc_id, text, similarity)
    found = occurrences.join(labels, ["k1", "k2"])
    return found.select("_id", "_text", "line", "group_id", F.struct("_id", "_text", "line").eqNullSafe(F.col("first_at")).alias("first"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """df with its text less the lines that repeat earlier ones, and n_lines and n_removed_lines (null texts: null, 0, 0).

    What repeats is said at duplicate_lines(). A text none of whose lines stay becomes "". Columns of df named like new ones
    are replaced.
    """
    df = df.drop("n_lines", "n_removed_lines")
    occurrences, labels = _groups(df, doc_id, text, similarity)
    again = occurrences.join(labels.where("not alone"), ["k1", "k2"]).where(~F.struct("_id", "_text", "line").eqNullSafe(F.col("first_at")))
    removed = again.select("_id", "_text", "line").distinct().groupBy("_id", "_text").agg(F.collect_list("line").alias("_gone"))
    removed = materialise(removed, "removed-lines")
    discard(occurrences, labels)
    keyed = df.withColumn("_id", F.col(doc_id)).withColumn("_text", F.xxhash64(text))
    out = keyed.alias("t").join(removed.alias("r"), F.col("t._id").eqNullSafe(F.col("r._id")) & (F.col("t._text") == F.col("r._text")), "left")
    lines = F.split(F.col("t." + text), "\n")
    kept = F.when(F.col("_gone").isNull(), F.col("t." + text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    columns = [kept.alias(text) if c == text else F.col(f"t.`{c}`") for c in df.columns]
    sizes = F.when(F.col("t." + text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines")
    return out.select(*columns, sizes, F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed_lines"))
