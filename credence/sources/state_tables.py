"""State tables: values that expire, queues, receipts, exports, seeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import kernels


def live_values(values: DataFrame, clock: Column) -> DataFrame:
    """Rows of (key, value, written, ttl seconds) that have not expired, the last one per key."""
    last = Window.partitionBy("key").orderBy(F.desc("written"), F.desc("value"))
    alive = F.col("ttl").isNull() | (F.unix_timestamp(clock) < F.unix_timestamp("written") + F.col("ttl"))
    newest = values.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    return newest.filter(alive)


def divert(rows: DataFrame, over_quota: Column, clock: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that may go on, and those that wait in the queue: kind, text, project, created_at."""
    over = F.coalesce(over_quota, F.lit(False))
    wait = rows.filter(over).select(F.lit("fact").alias("kind"), "text", "project", clock.alias("created_at"))
    return rows.filter(~over), wait


def drained(queue: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The oldest ``most`` rows of a queue, and the rest."""
    placed = queue.orderBy("created_at", "id").limit(most)
    return placed, queue.join(placed.select("id"), "id", "left_anti")


def keep_receipts(receipts: DataFrame, new: DataFrame, most: int = 500) -> DataFrame:
    """Receipts with the new ones, of which the last ``most`` stay."""
    return receipts.unionByName(new).orderBy(F.desc("ts"), "query_hash").limit(most)


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet below ``path``, by its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def seeded(anchors: DataFrame, seeds: DataFrame, embed: Callable[[Column], Column], clear: bool = False) -> DataFrame:
    """Anchors (name, emb, memory_count) with those of seeds (name, text) added or replaced; ``clear`` drops all others first."""
    new = seeds.select("name", kernels.normalise(kernels.wide(embed(F.col("text")))).alias("emb"), F.lit(0).cast("long").alias("memory_count"))
    kept = anchors.limit(0) if clear else anchors.join(new.select("name"), "name", "left_anti")
    return kept.select("name", kernels.wide(F.col("emb")).alias("emb"), F.col("memory_count").cast("long").alias("memory_count")).unionByName(new)
