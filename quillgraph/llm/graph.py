"""Connected components, and links between the members of shared buckets without all pairs of a bucket. DataFrames only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b; longs): the smallest node of its connected component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and contracts the links; at most
    half the nodes are left. No links give no rows; loops and repeated links do no harm.
    """
    edges = materialise(links.where("a != b").select("a", "b").distinct(), "links")
    mapping = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hook = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("parent")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            jump = hook.join(up, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved"))
            jump = materialise(jump, "hooks")
            discard(hook)
            hook = jump
            if jump.where("moved").isEmpty():
                break
        ends = [hook.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in "ab"]
        left = edges.join(ends[0], "a").join(ends[1], "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        left = materialise(left.distinct(), "links")
        discard(edges)
        edges = left
        if mapping is None:
            mapping = materialise(hook.select("node", F.col("parent").alias("root")), "roots")
        else:
            step = hook.select(F.col("node").alias("root"), "parent")
            moved = materialise(mapping.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
            discard(mapping)
            mapping = moved
        discard(hook)
        if edges.isEmpty():
            discard(edges)
            return mapping


#: Members of a bucket that all its members are held against.
LEADERS = 3
#: A bucket that still holds several components is divided further if it has more members than this.
LARGE = 64


def bucket_components(buckets: DataFrame, nodes: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], divide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of the components of all verified links between nodes that share a bucket.

    buckets: (bucket, node); nodes: (node, *payload), a row for each node; near(x, y): a condition on the payloads of the
    frames aliased x and y that no verified link violates; verify(pairs (a, b)) keeps the pairs that are links;
    divide(members (bucket, node, root, *payload)): the same members in smaller buckets such that two that may be linked
    still share one; without it buckets stay as they are.

    First every member is held against the LEADERS members of its bucket that share most with others, which links most of a
    large group of copies by a few times as many pairs as it has members. Buckets that then are one component are done. Of
    the others those of more than LARGE members are divided, and in what remains pairs across components are tested inside
    the join. Pairs within a component need no test, so no link that matters is lost.
    """
    own = Window.partitionBy("bucket")
    members = buckets.select("*", F.count("*").over(own).alias("size")).where("size > 1")
    members = materialise(members, "buckets")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = members.select("bucket", "node").join(degree, "node")
    ranked = ranked.select("bucket", "node", F.row_number().over(own.orderBy(F.desc("degree"), "node")).alias("place"))
    ranked = materialise(ranked, "ranked")
    leaders = ranked.where(F.col("place") <= LEADERS)
    # at most LEADERS rows a bucket on one side
    led = leaders.groupBy("bucket").agg(*[F.max(F.when(F.col("place") == k, F.col("node"))).alias(f"l{k}") for k in range(1, LEADERS + 1)])
    stars = ranked.join(led, "bucket").select("node", F.explode(F.array(*[f"l{k}" for k in range(1, LEADERS + 1)])).alias("lead")).where("lead != node")
    stars = materialise(stars.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "stars")
    discard(ranked)
    tested = stars.join(nodes.alias("y"), F.col("b") == F.col("y.node")).join(nodes.alias("x"), F.col("a") == F.col("x.node")).where(near("x", "y"))
    links = verify(tested.select("a", "b"))
    roots = components(links)
    labelled = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = labelled.select("*", F.min("root").over(own).alias("_low"), F.max("root").over(own).alias("_high"), F.count("*").over(own).alias("size")).where("_low != _high")
    mixed = materialise(mixed.select("bucket", "node", "root", "size").join(nodes, "node"), "mixed")
    discard(members)
    # a table's columns may be null once read; where the payload's may not, conditions on it are less code
    sure = {f.name for f in nodes.schema if not f.nullable and f.dataType.simpleString() == "bigint"}
    whole = mixed.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in sure else c for c in mixed.columns])
    parts = [(whole.where(F.col("size") <= LARGE) if divide else whole).drop("size")]
    large = whole.where(F.col("size") > LARGE).drop("size")
    if divide and not large.isEmpty():
        large = divide(large).select("*", F.min("root").over(own).alias("_low"), F.max("root").over(own).alias("_high")).where("_low != _high").drop("_low", "_high")
        parts.append(materialise(large, "divided"))
    pairs = None
    for m in parts:
        across = m.alias("x").join(m.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") < F.col("y.root")) & near("x", "y"))
        some = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        pairs = some if pairs is None else pairs.union(some)
    pairs = materialise(pairs.distinct().join(stars, ["a", "b"], "left_anti"), "across")
    discard(mixed, stars, *parts[1:])
    more = verify(pairs)
    out = roots if more.isEmpty() else components(links.union(more))
    discard(pairs, links, more, *([] if out is roots else [roots]))
    return out
