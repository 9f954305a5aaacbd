"""Candidate sources of a retrieval: vectors, keywords, fusion, time, access, hot list."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import kernels, text
from credence.session import checkpointed


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_topk(rows: DataFrame, query: list[float], k: int, scope: Column | None = None) -> DataFrame:
    """The k rows nearest a query vector: id, score; the filter goes before the sort."""
    held = rows.filter(F.col("embedding").isNotNull())
    held = held if scope is None else held.filter(scope)
    scored = held.select("id", F.round(kernels.dot(F.col("embedding"), vector_literal(query)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def blended_topk(rows: DataFrame, query: list[float], k: int, project: str, default: str) -> DataFrame:
    """Top k of a project united with the default project's top max(3, 30 %), best score per id."""
    extra = max(3, int(0.3 * k + 0.5))
    own = cosine_topk(rows, query, k, F.col("project") == project)
    other = cosine_topk(rows, query, extra, F.col("project") == default)
    return own.unionByName(other).groupBy("id").agg(F.max("score").alias("score"))


def bm25(docs: DataFrame, query_terms: list[str], k: int, match_all: bool, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, scope: Column | None = None) -> DataFrame:
    """Ranked keyword hits: id, score.

    Texts are read once: a narrow table keeps each row's length and its counts of the
    query's terms, from which the corpus statistics and the hits are taken. ``scope``
    limits the hits, not the statistics.
    """
    wanted = sorted(set(query_terms))
    seen = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    t = docs.select(F.col(id_col).alias("id"), text.terms(F.col(text_col)).alias("terms"), seen.alias("seen"))
    narrow = checkpointed(t.select("id", "seen", F.size("terms").alias("length"), F.array(*[F.size(F.filter("terms", _equal(w))) for w in wanted]).alias("tf")))
    there = [F.count_if(F.get("tf", n) > 0) for n in range(len(wanted))]
    n, avg, *df = narrow.agg(F.count("*"), F.avg("length"), *there).first()
    idf = [max(1e-6, math.log((n - d + 0.5) / (d + 0.5))) for d in df]
    saturated = lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / (avg or 1)))
    score = sum((F.when(F.get("tf", i) > 0, idf[i] * saturated(F.get("tf", i))).otherwise(0.0) for i in range(len(wanted))), F.lit(0.0))
    hit = (F.forall if match_all else F.exists)("tf", lambda x: x > 0)
    return narrow.filter(F.col("seen") & hit).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _equal(word: str):
    return lambda x: x == word


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, score): id, rrf."""
    ranked = None
    for n, rows in enumerate(lists):
        by = Window.partitionBy("list").orderBy(F.desc("score"), "id")  # each list is a bounded top k
        one = rows.withColumn("list", F.lit(n)).withColumn("rank", F.row_number().over(by))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("rrf"))


def temporal_window(rows: DataFrame, days: int, clock: Column, newest: int = 20, sessions: int = 10) -> DataFrame:
    """Newest rows, and newest sessions, from two days before the day a cue names to one day after it."""
    age = kernels.age_days(F.col("ts"), clock)
    held = rows.filter((age <= days + 2) & (age >= max(0, days - 1))).select("id", "ts", "memory_type")
    top = held.orderBy(F.desc("ts"), "id").limit(newest)
    last = held.filter("memory_type = 'session'").orderBy(F.desc("ts"), "id").limit(sessions)
    return top.unionByName(last).distinct()


def access_top(rows: DataFrame, k: int = 20) -> DataFrame:
    return rows.select("id", "access_count").orderBy(F.desc("access_count"), "id").limit(k)


def hot_list(log: DataFrame, key: str, ts: str, k: int = 100) -> DataFrame:
    """Most recent distinct keys of an access log: aggregated before the sort."""
    return log.groupBy(F.col(key).alias("id")).agg(F.max(ts).alias("last_seen")).orderBy(F.desc("last_seen"), "id").limit(k)
