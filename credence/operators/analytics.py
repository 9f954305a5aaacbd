"""Reports over the record store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import text


def stats(rows: DataFrame) -> DataFrame:
    """Counts by domain, by type and in total, in one pass over grouping sets."""
    both = rows.groupingSets([[F.col("domain")], [F.col("memory_type")], []], "domain", "memory_type")
    return both.agg(F.count("*").alias("n"), F.round(F.avg("sigma"), 6).alias("avg_sigma"), F.count_if(F.col("contradiction")).alias("contradictions"))


def sigma_buckets(rows: DataFrame) -> DataFrame:
    s, a = F.col("sigma"), F.col("access_count")
    return rows.agg(
        F.count_if(s < 0.3).alias("sharp"), F.count_if((s >= 0.3) & (s < 0.8)).alias("clear"), F.count_if((s >= 0.8) & (s < 1.8)).alias("vague"), F.count_if(s >= 1.8).alias("fading"),
        F.count_if(a > 50).alias("hot"), F.count_if((a > 0) & (a <= 50)).alias("warm"), F.count_if(a == 0).alias("cold"),
    )


def listing(rows: DataFrame, sort: str = "ts", limit: int = 50, domain: str | None = None, since: str | None = None) -> DataFrame:
    rows = rows if domain is None else rows.filter(F.col("domain") == domain)
    rows = rows if since is None else rows.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    order = F.asc("sigma") if sort == "sigma" else F.desc(sort)
    top = rows.select("id", "domain", "memory_type", "ts", "access_count", "last_accessed", F.round("sigma", 6).alias("sigma"), F.substring("text", 1, 80).alias("head"))
    return top.orderBy(order, "id").limit(min(limit, 500))


def relations(pairs: DataFrame, rows: DataFrame, supersedes: float) -> DataFrame:
    """Pairs as edges from the newer to the older row: 'supersedes' from a similarity on, else 'conflicts_with'."""
    side = lambda c: rows.select(F.col("id").alias(c), F.col("ts").alias(f"ts_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    older_a = F.col("ts_a") <= F.col("ts_b")
    return both.select(F.when(older_a, F.col("b")).otherwise(F.col("a")).alias("from_id"), F.when(older_a, F.col("a")).otherwise(F.col("b")).alias("to_id"), F.when(F.col("cos") >= supersedes, "supersedes").otherwise("conflicts_with").alias("relation_type"))


def timeline(rows: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows, oldest first, each with its strongest mark."""
    newest = rows.orderBy(F.desc("ts"), "id").limit(limit)
    gone = edges.filter("relation_type = 'supersedes'").select(F.col("to_id").alias("id")).distinct().withColumn("old", F.lit(True))
    torn = edges.filter("relation_type = 'conflicts_with'")
    ends = torn.select(F.col("from_id").alias("id")).union(torn.select(F.col("to_id").alias("id"))).distinct().withColumn("torn", F.lit(True))
    marked = newest.join(gone, "id", "left").join(ends, "id", "left")
    mark = F.when(F.col("old"), "[SUPERSEDED]").when(F.col("torn"), "[CONFLICT]").when(F.col("contradiction"), "[FLAGGED]").otherwise("")
    return marked.select("id", "ts", F.date_format("ts", "yyyy-MM").alias("month"), mark.alias("mark")).orderBy("ts", "id")


def history(events: DataFrame) -> DataFrame:
    """Confidence history of a key from its accesses in order: id, n, sigma, recorded_at."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.withColumn("n", F.row_number().over(by) - 1)
    return steps.select(F.col("user_id").alias("id"), "n", F.greatest(0.5 * F.pow(F.lit(0.85), F.col("n")), F.lit(0.15)).alias("sigma"), F.col("ts").alias("recorded_at"), "event_id")


def drift(past: DataFrame) -> DataFrame:
    """First and last sigma of each key and what the fall says."""
    ends = past.groupBy("id").agg(F.min_by("sigma", "n").alias("first"), F.max_by("sigma", "n").alias("last"), F.count("*").alias("steps"))
    out = ends.select("id", F.round("first", 6).alias("first_sigma"), F.round("last", 6).alias("last_sigma"), "steps")
    return out.withColumn("drop", F.round(F.col("first_sigma") - F.col("last_sigma"), 6)).withColumn("verdict", text.drift_verdict(F.col("drop")))


def backfill(rows: DataFrame, past: DataFrame, limit: int | None = None) -> DataFrame:
    """Synthetic histories for rows that have none: id, step, sigma."""
    from credence.functions import kernels

    bare = rows.join(past.select("id").distinct(), "id", "left_anti")
    bare = bare if limit is None else bare.orderBy("id").limit(limit)
    n = F.greatest(F.lit(1), F.least(F.col("access_count"), F.lit(5)))
    return bare.select("id", F.posexplode(kernels.trajectory(F.col("sigma"), n)).alias("step", "sigma"))


def orphans(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    return rows.select("id").join(vectors.select(F.col("vec_id").alias("id")), "id", "left_anti")


def galaxy(rows: DataFrame) -> DataFrame:
    held = rows.filter(F.col("cluster_id").isNotNull())
    return held.groupBy("cluster_id", "memory_type").agg(F.count("*").alias("n"), F.round(F.avg("access_count"), 6).alias("avg_access"))


def galaxy_clusters(cells: DataFrame) -> DataFrame:
    """Cells put together per cluster: counts, weighted mean, kinds."""
    return cells.groupBy("cluster_id").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("avg_access")) / F.sum("n"), 4).alias("avg_access"), F.array_join(F.array_sort(F.collect_set("memory_type")), ",").alias("kinds"))


def marked(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(condition)
