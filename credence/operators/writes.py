"""The write path: what happens to each incoming record (merge, contradiction or insert)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import kernels, text
from credence.operators.similarity import cross_pairs


def candidates(batch: DataFrame, corpus: DataFrame, floor: float, k: int = 10) -> DataFrame:
    """Up to k nearest stored rows per incoming row of the same project: new_id, old_id, cos. Stored rows are not compared with each other."""
    pairs = cross_pairs(batch, corpus, "project", floor).select(F.col("a").alias("new_id"), F.col("b").alias("old_id"), "cos")
    by = Window.partitionBy("new_id").orderBy(F.desc("cos"), "old_id")
    return pairs.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).drop("n")


def merge_ceiling(kind: Column, same_cluster: Column, session: float = 0.90, other: float = 0.97) -> Column:
    """Similarity that a merge across clusters must reach; none within a cluster."""
    return F.when(same_cluster, F.lit(-2.0)).otherwise(F.when(kind == "session", session).otherwise(other))


def decide(batch: DataFrame, corpus: DataFrame, floor: float = 0.85, session: float = 0.90, other: float = 0.97, same: float = 0.20, across: float = 0.08, negation: float = 0.88, status: float = 0.75, dims: int = 768) -> DataFrame:
    """Action per incoming row: new_id, action, old_id.

    Equal text, then equal text but for case and punctuation, then a contradiction,
    then the nearest row whose confidence is close enough; else the row is inserted.
    """

    def equal(key: Column, name: str) -> DataFrame:
        """The smallest stored id of each key: keys are hashed (two hashes) and reduced to one row each before they are joined."""
        hashed = lambda d, n: d.select(F.col("id").alias(n), F.xxhash64("project", key).alias("k1"), F.xxhash64(F.lit(1), "project", key).alias("k2"), key.isNotNull().alias("known")).filter("known").drop("known")
        first = hashed(corpus, "old_id").groupBy("k1", "k2").agg(F.min("old_id").alias(name))
        return hashed(batch, "new_id").join(first, ["k1", "k2"]).select("new_id", name)

    exact, loose = equal(F.col("text"), "exact"), equal(text.exact_key(F.col("text")), "loose")
    side = lambda d, n, p: d.select(F.col("id").alias(n), *[F.col(c).alias(f"{p}_{c}") for c in ("text", "sigma", "cluster_id", "memory_type")])
    near = candidates(batch, corpus, floor).join(side(batch, "new_id", "n"), "new_id").join(side(corpus, "old_id", "o"), "old_id")
    torn = text.contradicts(F.col("n_text"), F.col("o_text"), F.col("cos"), negation, status)
    together = F.coalesce(F.col("n_cluster_id") == F.col("o_cluster_id"), F.lit(False))
    close = kernels.same_mean_distance(F.col("n_sigma"), F.col("o_sigma"), dims) < F.when(together, same).otherwise(across)
    fits = (F.col("cos") >= merge_ceiling(F.col("n_memory_type"), together, session, other)) & close
    first = lambda c: F.min_by("old_id", F.when(c, -F.col("cos")))
    judged = near.groupBy("new_id").agg(first(torn).alias("torn"), first(fits).alias("fits"))
    all_ = batch.select(F.col("id").alias("new_id")).join(exact, "new_id", "left").join(loose, "new_id", "left").join(judged, "new_id", "left")
    merged = F.coalesce("exact", "loose")
    action = F.when(merged.isNotNull(), "merged").when(F.col("torn").isNotNull(), "contradiction").when(F.col("fits").isNotNull(), "merged").otherwise("spawned")
    return all_.select("new_id", action.alias("action"), F.coalesce(merged, "torn", "fits").alias("old_id"))


def near_misses(pairs: DataFrame, above: float = 0.85) -> DataFrame:
    """Pending edges for inserted rows that nearly merged."""
    return pairs.filter(F.col("cos") > above).select(F.col("new_id").alias("from_id"), F.col("old_id").alias("to_id"), F.lit("pending_judge").alias("relation_type"), F.col("cos").alias("confidence"))


def reinforce(rows: DataFrame, hits: DataFrame, sizes: DataFrame, clock: Column) -> DataFrame:
    """Rows after a retrieval: hits are sharpened by their domain's size, counted and touched."""
    marked = rows.join(hits.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left").join(F.broadcast(sizes), "domain", "left")  # one row per domain
    hit = F.coalesce("__hit", F.lit(False))
    sharper = kernels.sharpen(F.col("sigma"), F.col("contradiction"), F.coalesce("domain_size", F.lit(10)))
    return marked.withColumns({
        "sigma": F.when(hit, sharper).otherwise(F.col("sigma")), "access_count": F.col("access_count") + hit.cast("int"),
        "last_accessed": F.when(hit, clock).otherwise(F.col("last_accessed")),
    }).drop("__hit", "domain_size")


def supersede(pairs: DataFrame) -> DataFrame:
    """Edges from the newer to the older of (a, ts_a, b, ts_b); of equal times a is the older."""
    older_a = F.coalesce("ts_a", F.lit(0)) <= F.coalesce("ts_b", F.lit(0))
    return pairs.select(F.when(older_a, F.col("b")).otherwise(F.col("a")).alias("from_id"), F.when(older_a, F.col("a")).otherwise(F.col("b")).alias("to_id"))


def topic_upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by (project, topic_key): the text is replaced and the revision counted, unknown keys are added."""
    held = rows.join(new.select("project", "topic_key", F.col("text").alias("__text")), ["project", "topic_key"], "left")
    changed = held.withColumns({"revision_count": F.col("revision_count") + F.col("__text").isNotNull().cast("int"), "text": F.coalesce("__text", "text")}).drop("__text")
    added = new.join(rows.select("project", "topic_key"), ["project", "topic_key"], "left_anti").withColumn("revision_count", F.lit(1))
    return changed.unionByName(added, allowMissingColumns=True)
