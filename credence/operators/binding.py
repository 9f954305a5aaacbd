"""The record store as a table, bound to the generic test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clocks that stand in for the wall clock: scoring, and maintenance.
NOW, NOW_MAINT = "2024-02-01 00:00:00", "2024-02-15 00:00:00"

#: One text for Spark and DuckDB.
MEMORIES_SQL = """
SELECT d.doc_id AS id, d.text AS text, d.source AS project, d.lang AS domain,
  CASE d.doc_id % 5 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural'
       WHEN 3 THEN 'session' ELSE 'decision' END AS memory_type,
  e.embedding AS embedding, e.label AS cluster_id,
  coalesce(a.n, 0) AS access_count,
  TIMESTAMP '2024-01-01 00:00:00' + ((d.doc_id * 37) % 44640) * INTERVAL '1' MINUTE AS ts,
  coalesce(a.t1, TIMESTAMP '2024-01-01 00:00:00' + ((d.doc_id * 37) % 44640) * INTERVAL '1' MINUTE) AS last_accessed,
  CASE WHEN a.n IS NULL THEN CAST(0.5 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (d.doc_id % 90)
       ELSE greatest(CAST(0.5 AS DOUBLE) * power(CAST(0.85 AS DOUBLE), least(a.n, 8)), CAST(0.15 AS DOUBLE))
  END AS sigma,
  (d.doc_id % 17 = 0) AS contradiction,
  CASE WHEN d.doc_id % 23 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' END AS valid_to
FROM {documents} d
LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id
LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS t1 FROM {events} GROUP BY user_id) a ON a.user_id = d.doc_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MEMORIES_SQL, **{n: table(spark, sf_dir, n) for n in ("documents", "embeddings", "events")})


def memories_cte() -> str:
    return "memories AS (" + MEMORIES_SQL.format(documents="documents", embeddings="embeddings", events="events") + ")"


def now(clock: str = NOW) -> Column:
    return F.lit(clock).cast("timestamp")


def in_scope(project: str, strict: bool = False, default: str = "default", column: str = "project") -> Column:
    """Rows of a project: all for the default one, its own only if strict, else its own and the default's."""
    own = F.col(column) == project
    return F.lit(True) if project == default else own if strict else own | (F.col(column) == default)


def is_valid(clock: str = NOW) -> Column:
    return F.col("valid_to").isNull() | (F.col("valid_to") > now(clock))
