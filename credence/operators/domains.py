"""Domains: choosing one for a record, their centroids, what their summaries are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import kernels
from credence.operators import similarity

GENERAL = "general"
#: Similarity from which the nearest domain is taken unasked, and below which none is; most domains there may be.
ACCEPT, FLOOR, CAP = 0.82, 0.30, 50


def ranked_anchors(rows: DataFrame, anchors: DataFrame, floor: float = FLOOR, most: int = 5) -> DataFrame:
    """Per row the nearest anchors at or above the floor: id, near (array of name and sim, best first)."""
    small = anchors.select("name", F.col("emb"))
    if small.limit(10_001).count() > 10_000:
        raise ValueError("more anchors than a broadcast table may hold")
    pairs = rows.filter(F.col("embedding").isNotNull()).select("id", "embedding").join(F.broadcast(small))
    scored = pairs.select("id", F.round(kernels.dot(F.col("embedding"), F.col("emb")), 6).alias("sim"), "name")
    best = scored.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("sim") >= floor, F.struct((-F.col("sim")).alias("o"), "name", "sim")))).alias("near"))
    return best.select("id", F.slice(F.transform("near", lambda x: F.struct(x["name"].alias("name"), x["sim"].alias("sim"))), 1, most).alias("near"))


def resolve_choice(choice: Column, sims: Column, at_cap: Column, fallback: Column, floor: float = FLOOR) -> Column:
    """What a classifier's choice means: struct of domain and mint.

    ``sims`` maps the names of all domains to their similarity. No choice means the
    fallback; a known domain must reach the floor; an unknown one is minted unless
    there are as many as there may be.
    """
    known = sims[choice]
    kept = F.when(choice.isNull(), fallback).when(choice == GENERAL, F.lit(GENERAL)).when(known.isNotNull(), F.when(known >= floor, choice).otherwise(fallback)).when(at_cap, fallback).otherwise(choice)
    mint = choice.isNotNull() & (choice != GENERAL) & known.isNull() & ~at_cap
    return F.struct(kept.alias("domain"), F.coalesce(mint, F.lit(False)).alias("mint"))


def classify(rows: DataFrame, anchors: DataFrame, classifier: Callable[[Column, Column], Column] | None = None, accept: float = ACCEPT, floor: float = FLOOR, cap: int = CAP) -> DataFrame:
    """Domain of each row that is to be stored: id, domain, mint.

    The nearest domain is taken from ``accept`` on. Below, ``classifier`` (of the text
    and the names of the five nearest) may choose; without a choice it is the nearest
    from the floor on, else the general one.
    """
    near = ranked_anchors(rows, anchors, -2.0, 10_000)
    n = anchors.count()
    some = near.join(rows.select("id", "text"), "id").withColumn("best", F.get("near", 0))
    offered = F.slice(F.transform(F.filter("near", lambda x: x["sim"] >= floor), lambda x: x["name"]), 1, 5)
    fallback = F.when(F.col("best.sim") >= floor, F.col("best.name")).otherwise(GENERAL)
    choice = F.lit(None).cast("string") if classifier is None else classifier(F.col("text"), offered)
    made = resolve_choice(choice, F.map_from_entries("near"), F.lit(n >= cap), fallback, floor)
    taken = F.when(F.col("best.sim") >= accept, F.struct(F.col("best.name").alias("domain"), F.lit(False).alias("mint"))).otherwise(made)
    return some.select("id", taken.alias("t")).select("id", "t.domain", "t.mint")


def classify_batch(rows: DataFrame, anchors: DataFrame, classifier: Callable[[Column, Column], Column] | None = None, accept: float = ACCEPT, floor: float = FLOOR) -> DataFrame:
    """Domain of each row of a batch, with the domains as they are: id, domain.

    Between floor and accept the classifier may override the nearest, by a known name only.
    """
    near = ranked_anchors(rows, anchors, -2.0, 10_000).join(rows.select("id", "text"), "id").withColumn("best", F.get("near", 0))
    names = F.transform("near", lambda x: x["name"])
    choice = F.lit(None).cast("string") if classifier is None else classifier(F.col("text"), F.slice(names, 1, 5))
    between = F.when(F.array_contains(names, choice), choice).otherwise(F.col("best.name"))
    return near.select("id", F.when(F.col("best.sim") < floor, GENERAL).when(F.col("best.sim") >= accept, F.col("best.name")).otherwise(between).alias("domain"))


def fold_centroids(anchors: DataFrame, hits: DataFrame) -> DataFrame:
    """Anchors after rows (name, embedding) joined them: the running mean by count, of unit length: name, emb, memory_count."""
    sums = similarity.centroids(hits, "name").select(F.col("label").alias("name"), F.col("sum").alias("__sum"), F.col("cnt").alias("__k"))
    held = anchors.join(sums, "name", "left").withColumn("__n", F.coalesce(F.col("memory_count"), F.lit(0)))
    mean = F.zip_with(kernels.wide(F.col("emb")), "__sum", lambda v, s: (v * F.col("__n") + s) / (F.col("__n") + F.col("__k")))
    return held.select(
        "name", F.when(F.col("__k").isNull(), kernels.wide(F.col("emb"))).otherwise(kernels.normalise(mean)).alias("emb"),
        (F.col("__n") + F.coalesce("__k", F.lit(0))).cast("long").alias("memory_count"),
    )


def update_centroids(anchors: DataFrame, hits: DataFrame, cap: int = CAP) -> DataFrame:
    """``fold_centroids`` for stored rows (id, name, embedding): none for the general domain, unknown names become
    anchors as long as there is room (by their first id), the rows of others go to the nearest anchor."""
    wanted = hits.filter(F.col("name") != GENERAL)
    unknown = wanted.join(anchors.select("name"), "name", "left_anti").groupBy("name").agg(F.min("id").alias("first"))
    room = max(0, cap - anchors.count())
    new = unknown.orderBy("first", "name").limit(room).select("name")  # at most cap rows
    minted = similarity.centroids(wanted.join(F.broadcast(new), "name", "left_semi"), "name").select(F.col("label").alias("name"), "emb", F.col("cnt").alias("memory_count"))
    lost = wanted.join(anchors.select("name"), "name", "left_anti").join(F.broadcast(new), "name", "left_anti")
    moved = similarity.nearest_anchor(lost, anchors).join(lost.select("id", "embedding"), "id").select("name", "embedding")
    known = wanted.join(anchors.select("name"), "name", "left_semi").select("name", "embedding")
    return fold_centroids(anchors, known.unionByName(moved)).unionByName(minted)


def assign_micros(rows: DataFrame, micros: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Micro-cluster of each row: id, cluster_id, is_new, sim; ``micros`` holds cluster_id and sum. Far rows start clusters of their own id."""
    anchors = micros.select(F.col("cluster_id").cast("string").alias("name"), kernels.normalise(F.col("sum")).alias("emb"))
    near = similarity.nearest_anchor(rows, anchors)
    fits = F.coalesce(F.col("cos") >= threshold, F.lit(False))
    held = rows.filter(F.col("embedding").isNotNull()).select("id").join(near, "id", "left")
    return held.select("id", F.when(fits, F.col("name")).otherwise(F.concat(F.lit("new-"), F.col("id").cast("string"))).alias("cluster_id"), (~fits).alias("is_new"), F.when(fits, F.col("cos")).otherwise(-1.0).alias("sim"))


def commit_micros(micros: DataFrame, assigned: DataFrame, rows: DataFrame) -> DataFrame:
    """Micro-clusters after the assigned rows were added: cluster_id, sum, count."""
    sums = similarity.centroids(assigned.join(rows.select("id", "embedding"), "id"), "cluster_id").select(F.col("label").alias("cluster_id"), F.col("sum").alias("__sum"), F.col("cnt").alias("__k"))
    both = micros.select(F.col("cluster_id").cast("string").alias("cluster_id"), "sum", "count").join(sums, "cluster_id", "full")
    added = F.when(F.col("sum").isNull(), F.col("__sum")).when(F.col("__sum").isNull(), kernels.wide(F.col("sum"))).otherwise(F.zip_with(kernels.wide(F.col("sum")), "__sum", lambda x, y: x + y))
    return both.select("cluster_id", added.alias("sum"), (F.coalesce("count", F.lit(0)) + F.coalesce("__k", F.lit(0))).cast("long").alias("count"))


def summary_inputs(rows: DataFrame, clock: Column, days: int = 90, most: int = 15, fallback: int = 10) -> DataFrame:
    """Rows that a domain's summary is made of: domain, rank, id.

    The most read of the last ``days``, the newest first among equals; for domains
    without any, the most read of all.
    """
    recent = F.col("ts") > clock - F.expr(f"interval {days} days")
    held = rows.select("domain", "id", "ts", "access_count", recent.alias("recent"))
    any_recent = F.max("recent").over(Window.partitionBy("domain"))
    late = Window.partitionBy("domain", "recent").orderBy(F.desc("access_count"), F.desc("ts"), "id")
    all_ = Window.partitionBy("domain").orderBy(F.desc("access_count"), "id")
    placed = held.withColumn("any", any_recent).filter(F.col("recent") | ~F.col("any"))
    rank = F.when(F.col("any"), F.row_number().over(late)).otherwise(F.row_number().over(all_))
    return placed.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("any"), most).otherwise(fallback)).select("domain", "rank", "id")


def stale_summaries(rows: DataFrame, anchors: DataFrame, least: int = 5, most: int = 20, growth: float = 1.2) -> DataFrame:
    """Large domains whose summary was never made or is of far fewer rows: name, actual."""
    large = anchors.filter(F.col("memory_count") >= least).orderBy(F.desc("memory_count"), "name").limit(most)  # at most ``most`` rows
    counts = rows.groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("actual"))
    last = F.coalesce("last_summarized_count", F.lit(0))
    return counts.join(F.broadcast(large), "name").filter((last == 0) | (F.col("actual") > last * growth)).select("name", "actual")


def identity_inputs(rows: DataFrame, most: int = 20) -> DataFrame:
    """The most and last read semantic rows: rank, id, text."""
    top = rows.filter("memory_type = 'semantic'").orderBy(F.desc("access_count"), F.desc("last_accessed"), "id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("access_count"), F.desc("last_accessed"), "id"))).select("rank", "id", "text")


def identity_profile(rows: DataFrame, generate: Callable[[list[str]], str]) -> str | None:
    """A profile that a generator writes from ``identity_inputs`` (20 rows); none without any."""
    facts = [r.text for r in identity_inputs(rows).orderBy("rank").collect()]
    return (generate(facts).strip() or None) if facts else None


def unanchored(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows of the general domain, or of one that has no anchor; rows without a domain are neither."""
    named = rows.filter(F.col("domain").isNotNull() & (F.col("domain") != GENERAL))
    return rows.filter(F.col("domain") == GENERAL).unionByName(named.join(anchors.select(F.col("name").alias("domain")), "domain", "left_anti").select(*rows.columns))
