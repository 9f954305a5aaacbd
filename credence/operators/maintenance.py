"""Batch maintenance as table-to-table functions: decay, pruning, archiving, deduplication, relabelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credence.functions import kernels, text
from credence.operators.similarity import with_later


def decay_pass(rows: DataFrame, clock: Column, limit: int | None = None, prune_above: float = 2.0) -> DataFrame:
    """New sigma and whether the row is pruned; ``limit`` takes only the coldest rows, as a nightly run may."""
    rows = rows if limit is None else rows.orderBy("access_count", "ts", "id").limit(limit)
    delta = kernels.effective_delta(F.col("access_count"), kernels.age_days(F.col("last_accessed"), clock))
    new = F.round(kernels.decay(F.col("sigma"), delta), 6)
    return rows.select("id", new.alias("new_sigma")).withColumn("pruned", F.col("new_sigma") > prune_above)


def junk(rows: DataFrame, clock: Column, length: int = 80, days: int = 30) -> DataFrame:
    return rows.filter((F.col("access_count") == 0) & (F.col("memory_type") == "episodic") & (F.char_length("text") < length) & (kernels.age_days(F.col("ts"), clock) > days))


def cold(rows: DataFrame, clock: Column, days: int = 30, sigma: float = 1.5, limit: int | None = 100) -> DataFrame:
    """Rows to archive: never read, old, uncertain, no sessions or decisions; oldest first."""
    held = rows.filter((F.col("access_count") == 0) & ~F.col("memory_type").isin("session", "decision") & (kernels.age_days(F.col("ts"), clock) > days) & (F.col("sigma") > sigma))
    return held if limit is None else held.orderBy("ts", "id").limit(limit)


def archive(rows: DataFrame, path: str, clock: Column) -> DataFrame:
    """Write rows as JSON by type, then return their ids: what may be deleted."""
    rows.select("id", F.col("text").alias("original_text"), "domain", "memory_type", clock.alias("archived_at"), F.col("ts").alias("original_timestamp")).write.mode("append").partitionBy("memory_type").json(path)
    return rows.select("id")


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Each table without the rows that name a deleted id in any of its key columns."""
    out = {}
    for name, t in tables.items():
        for key in keys[name]:
            t = t.join(ids.select(F.col("id").alias(key)), key, "left_anti")
        out[name] = t
    return out


def merge_columns(rows: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the given columns replaced where ``updates`` has their id."""
    new = updates.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, "id", "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def insert_ignore(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return rows.unionByName(new.dropDuplicates([key]).join(rows.select(key), key, "left_anti"))


def exact_keepers(rows: DataFrame, key: Column | None = None) -> DataFrame:
    """Copies of a text: id, keeper. Kept: most read, then sharpest, then oldest. Keys are hashed before the shuffle."""
    name = F.xxhash64(F.col("text") if key is None else key)
    best = F.struct((-F.col("access_count")).alias("a"), F.round("sigma", 6).alias("s"), "ts", "id")
    keyed = rows.select("id", "access_count", "sigma", "ts", name.alias("k"))
    kept = keyed.groupBy("k").agg(F.min(best).alias("b"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(kept, "k").select("id", F.col("b.id").alias("keeper"))


def normalised_keepers(rows: DataFrame) -> DataFrame:
    return exact_keepers(rows, text.exact_key(F.col("text")))


def near_duplicates_to_drop(rows: DataFrame, scanned: Column, threshold: float, newest_first: bool, limit: int | None = None) -> DataFrame:
    """Ids of scanned rows that go because a live row of their project is alike; of a group one always stays.

    Neighbours are looked for among all rows. The scan goes by time and id; ``limit``
    takes only its first rows, as a nightly run may. A scanned row goes if a neighbour is
    not scanned or comes later in the scan: earlier neighbours of a row that has no such
    neighbour are gone by then, as that row is a later neighbour of theirs. So no fold is needed.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    place = F.coalesce(-micros if newest_first else micros, F.lit((1 << 63) - 2))  # rows without time come last
    held = rows.filter(F.col("embedding").isNotNull()).select("id", F.coalesce("project", F.lit("default")).alias("project"), "embedding", place.alias("place"), F.coalesce(scanned, F.lit(False)).alias("scanned"))
    if limit is not None:
        first = held.filter("scanned").orderBy("place", "id").limit(limit).select("id", F.lit(True).alias("first"))
        held = held.join(first, "id", "left").withColumn("scanned", F.coalesce("first", F.lit(False)))
    placed = held.withColumn("place", F.when(F.col("scanned"), F.col("place")).otherwise(F.lit((1 << 63) - 1)))
    return with_later(placed, "project", "place", threshold).join(placed.filter("scanned").select("id"), "id", "left_semi")


def singleton_domains(rows: DataFrame, least: int = 3) -> DataFrame:
    return rows.groupBy("domain").count().filter((F.col("count") < least) & (F.col("domain") != "general")).select("domain")


def remap(nearest: DataFrame, floor: float = 0.3) -> DataFrame:
    """The anchor a row moves to: the nearest if near enough, else 'general'."""
    return nearest.select("id", "cos", F.when(F.col("cos") >= floor, F.col("name")).otherwise("general").alias("target"))


def bulk_pattern(rows: DataFrame, pattern: str | None, project: str | None = None) -> DataFrame:
    """Rows whose text holds every part of a %-pattern (any case), of a project if one is named."""
    if not pattern and not project:
        raise ValueError("a pattern or a project is needed")
    for part in filter(None, (pattern or "").split("%")):
        rows = rows.filter(F.instr(F.lower("text"), part.lower()) > 0)
    return rows if project is None else rows.filter(F.col("project") == project)


def latest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Last write per key wins."""
    by = Window.partitionBy(key).orderBy(F.desc(ts))
    return rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")
