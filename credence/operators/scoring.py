"""Scoring of a candidate batch: normalisation, primary score, spreading activation, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import kernels, text
from credence.operators.candidates import vector_literal


def _all():
    """One window over the whole batch: candidate pools of bounded size only."""
    return Window.partitionBy(F.lit(0))


def min_max(v: Column, real: Column | None = None) -> Column:
    """Scaled to [0, 1] over the batch, 1 if constant; rows that are not real pass through."""
    own = v if real is None else F.when(real, v)
    low, high = F.min(own).over(_all()), F.max(own).over(_all())
    scaled = F.when(high == low, 1.0).otherwise((v - low) / (high - low))
    return scaled if real is None else F.when(real, scaled).otherwise(v)


def bm25_scaled(v: Column) -> Column:
    return F.when(F.max(v).over(_all()) == 0, 0.0).otherwise(min_max(v))


def candidate_pool(rows: DataFrame, query: list[float], k: int, scope: Column | None = None) -> DataFrame:
    """The k nearest rows with all their columns and ``cos``: ids first, then the wide columns."""
    held = rows.filter(F.col("embedding").isNotNull())
    held = held if scope is None else held.filter(scope)
    return held.withColumn("cos", kernels.dot(F.col("embedding"), vector_literal(query))).orderBy(F.desc("cos"), "id").limit(k)


def primary(pool: DataFrame, clock: Column, sigma_q: float, days: int | None = None) -> DataFrame:
    """Adds norm_cos and primary_score to a pool with ``cos`` (and bm25, entity, rrf, cohesion where known)."""
    have = pool.columns
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in have else F.lit(0.0)
    q = F.lit(sigma_q)
    damped = kernels.damped_cosine(F.col("cos"), F.col("sigma"), q)
    given = F.col("synthetic") if "synthetic" in have else None  # stands in for a similarity and stays as it is
    p = pool.withColumn("norm_cos", min_max(damped) if given is None else min_max(F.coalesce(given, damped), given.isNull()))
    p = p.withColumn("norm_bm25", bm25_scaled(known("bm25"))).withColumn("norm_rec", min_max(kernels.recency(F.col("last_accessed"), clock))).withColumn("norm_acc", min_max(kernels.access_frequency(F.col("access_count"))))
    base = kernels.base_score(F.col("norm_cos"), F.col("norm_bm25"), F.col("norm_rec"), F.col("norm_acc"), known("entity"), known("rrf"), known("cohesion"), kernels.temporal_boost(F.col("ts"), days, clock))
    overlap = kernels.distributional_score(F.col("norm_cos"), q, F.col("sigma"))
    return p.withColumn("primary_score", kernels.primary_score(base, kernels.session_length_penalty(F.col("memory_type"), F.col("text")), overlap))


def activate(scored: DataFrame, clock: Column, sigma_q: float, days: int | None = None, domain: str | None = None) -> DataFrame:
    """Adds ``score``: proximity to the three best rows spreads from sharp, uncontested rows."""
    three = scored.orderBy(F.desc("primary_score"), "id").limit(3).filter(F.col("embedding").isNotNull()).select(F.col("id").alias("a_id"), F.col("embedding").alias("a_emb"))
    near = (
        scored.join(F.broadcast(three), F.col("id") != F.col("a_id"))
        .groupBy("id").agg(F.avg(kernels.dot(F.col("embedding"), F.col("a_emb"))).alias("neighbours"))
    )
    relevant = days is not None or sigma_q > 0.6
    session = F.when(F.col("memory_type") == "session", (0.10 if relevant else 0.04) * F.col("norm_cos")).otherwise(0.0)
    same = F.lit(False) if domain is None else F.col("domain") == domain
    value = kernels.activation(
        F.col("primary_score"), F.coalesce("neighbours", F.lit(0.0)), F.col("sigma"), F.col("contradiction"), same, session,
        kernels.freshness(F.col("ts"), clock), F.col("text").rlike(text.FILE_EDIT),
    )
    return scored.join(near, "id", "left").withColumn("score", value)


def two_hops(rows: DataFrame, start: list[int], k: int = 3, floor: float = 0.65, fade: float = 0.6) -> DataFrame:
    """Spreading over the k nearest neighbours (a row counts among its own) for two hops: id, score."""
    held = rows.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    frontier = held.filter(F.col("id").isin(start))
    seen, found = frontier.select("id"), None
    for hop in (1, 2):
        f = frontier.select(F.col("id").alias("f_id"), F.col("embedding").alias("f_emb"))
        by = Window.partitionBy("f_id").orderBy(F.desc("cos"), "id")
        near = held.join(F.broadcast(f)).withColumn("cos", F.round(kernels.dot(F.col("embedding"), F.col("f_emb")), 6))  # at most 3, then 9 rows
        top = near.withColumn("rank", F.row_number().over(by)).filter((F.col("rank") <= k) & (F.col("cos") >= floor))
        new = top.join(seen, "id", "left_anti").groupBy("id").agg(F.max("cos").alias("cos"))
        step = new.select("id", F.round(F.col("cos") * fade**hop, 6).alias("score"))
        found = step if found is None else found.unionByName(step)
        seen = seen.unionByName(new.select("id"))
        frontier = held.join(F.broadcast(new.select("id")), "id")
    return found


def cohesion_bonus(edges: DataFrame) -> DataFrame:
    """From (id, entity) edges: id, bonus. An entity counts its members once, before the shuffle of edges."""
    members = edges.groupBy("entity").agg(F.count("*").alias("m"))
    share = (F.col("m") - 1) / F.log2(F.greatest(F.lit(2), F.col("m")).cast("double"))
    return edges.join(members, "entity").groupBy("id").agg(F.round(kernels.cohesion(F.sum(share)), 6).alias("bonus"))
