"""Links between the members of buckets, and connected components, all in shuffles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import drop_materialised, materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Root (smallest node) of every node that has an edge: columns node, root."""
    hung = hang(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    return hung.unionByName(hung.select(F.col("root").alias("node"), "root").distinct())


def hang(edges: DataFrame) -> DataFrame:
    """Root (smallest node of its component) of every node of the edges (a, b) that is not its own root, as a written table: node, root.

    Each round hangs all neighbours of a node on the smallest one, first the larger
    neighbours of every node, then the smaller ones. A node's smallest neighbour is
    aggregated before the shuffle; the edges of a node with very many neighbours pass by
    in one task, and those to smaller nodes may spill. No round makes more edges than it
    was given. Every round is written to the shared folder; the
    last is the one after which every node hangs on its root alone.
    """
    kept, made = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), None
    while not _hung(kept):
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lower = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = lower.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        kept = materialise(small.distinct(), "stars")
        _drop(made)
        made = kept
    roots = materialise(kept.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "roots")
    _drop(made)
    return roots


def _hung(edges: DataFrame) -> bool:
    """Whether every node of the edges (u, v) either hangs on one node or is one that others hang on."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(0).alias("top"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("up"), F.lit(1).alias("top")))
    ways = ends.groupBy("node").agg(F.min("up").alias("x"), F.max("up").alias("y"), F.max("top").alias("top"))
    return not ways.agg(F.max((F.col("x") != F.col("y")) | (F.col("x").isNotNull() & (F.col("top") == 1)))).first()[0]


#: From one round to the next a bucket has so many times more stars.
_MORE_STARS = 16


def bucket_links(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], cross: Callable[[DataFrame], DataFrame] | None = None, likely: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Links (a, b) of every class b to the smallest class a of its component, by verified pairs that connect all similar members of each bucket.

    ``members`` is a written table: bucket, class, star (the bucket's smallest class),
    n (members of the bucket). ``verify`` keeps the similar ones of pairs (a, b).
    First each class is compared with one star; ``likely`` may drop unlike ones of these
    pairs unseen. While a bucket's members lie in different components, its star and some
    other members, about 16 of them, and at last all members are compared with the
    members of other components (without ``cross``, 16 times as many in every round). So
    pairs are only made where links have not yet joined a bucket, and no two similar
    members stay apart. No pair is verified twice.
    ``cross`` may make the pairs of a round: it gets the members (bucket, class, root, n)
    of buckets that are still open, with ``was`` and ``leads`` (star before and now), and
    returns the pairs (a, b) of a star and another member that may be similar, of
    different roots, none of which was a star before.
    """
    first = members.filter("class != star").groupBy("class").agg(F.min("star").alias("star")).select(F.col("star").alias("a"), F.col("class").alias("b"))
    seen = materialise(first if likely is None else likely(first), "pairs")
    found = materialise(verify(seen), "links")
    compared, roots, opened, stars = [seen], hang(found).withColumnRenamed("node", "class"), None, 0
    while True:
        known = members if opened is None else opened.drop("root")
        rooted = known.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("bucket")
        now_open = materialise(rooted.join(mixed, "bucket", "left_semi"), "open")
        _drop(opened, found)
        opened = now_open
        most = opened.agg(F.max("n")).first()[0]
        if not most:
            break
        more = max(1, stars) * _MORE_STARS
        if cross is not None and stars:
            more = most  # rows are only made of pairs that may be similar: the rest is done at once
        ranked = opened.select("bucket", "class", "root", "n", _leads(stars).alias("was"), _leads(more).alias("leads"))
        pairs = _star_pairs(ranked) if cross is None else cross(ranked)
        seen = functools.reduce(DataFrame.unionByName, compared)
        new = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
        found = materialise(verify(new), "links")
        compared.append(new)
        if not found.isEmpty():
            before, roots = roots, hang(_tree(roots).unionByName(found)).withColumnRenamed("node", "class")
            _drop(before)
        stars = more
        if stars >= most:
            _drop(found)
            break
    _drop(opened, *compared)
    return _tree(roots)


def _tree(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("root").alias("a"), F.col("class").alias("b"))


def _star_pairs(ranked: DataFrame) -> DataFrame:
    """Pairs of the new stars of open buckets with members of other components."""
    new = ranked.filter("not was")
    left = new.filter("leads").select("bucket", F.col("class").alias("a"), F.col("root").alias("ra"))
    right = new.select("bucket", F.col("class").alias("b"), F.col("root").alias("rb"), "leads")
    return left.join(right, "bucket").filter((F.col("ra") != F.col("rb")) & (~F.col("leads") | (F.col("a") < F.col("b"))))


def _leads(stars: int) -> Column:
    """Whether a member is one of about so many stars of its bucket; who was one stays one when there are more."""
    if stars < 1:
        return F.lit(False)
    first = F.col("class") == F.col("star")
    if stars == 1:
        return first
    share = F.shiftrightunsigned(F.xxhash64("bucket", "class"), 11) / F.lit(2.0**53)
    return first | (F.col("n") <= stars) | (share * F.col("n") < stars)


def _drop(*tables: DataFrame | None) -> None:
    for table in tables:
        if table is not None:
            drop_materialised(table)
