"""Streaming forms: session windows, deduplication of recent writes, hot list, queue drain."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.session import shared_folder


def drain(spark: SparkSession, folder: str, table: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", run: str | None = None) -> DataFrame:
    """Run a streaming query over the Parquet files of a folder until none is left; its rows as a table.

    Offsets and rows are kept below ``spark.checkpoint.dir``. A ``run`` that is named goes
    on where the last one of that name stopped, and reads only files that are new since;
    without a name every run is a new one.
    """
    path = f"{folder}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    source = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    out = f"{shared_folder(spark)}/credence/stream-{run or uuid.uuid4().hex}"
    made = build(source)
    if mode == "complete":
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/rows")

        writer = made.writeStream.outputMode("complete").foreachBatch(put)
    else:
        writer = made.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows")
    query = writer.option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _watched(events: DataFrame, delay: str, ts: str = "ts") -> tuple[DataFrame, str]:
    """Events with a watermark if they are a stream, and the type their times had; watermarks need times with a zone."""
    kind = events.schema[ts].dataType.simpleString()
    zoned = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return zoned.withWatermark(ts, delay) if events.isStreaming else zoned, kind


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Session windows per user with counts and sums; in a stream each is emitted when the watermark has passed its end."""
    late, kind = _watched(events, gap)
    w = F.session_window("ts", gap)
    return late.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").cast(kind).alias("started"), "n", "total")


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling hours by event type, emitted as they close."""
    late, kind = _watched(events, "10 minutes")
    return late.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast(kind).alias("hour"), "event_type", "n")


def first_writes(rows: DataFrame, keys: list[str], ts: str = "ts", keep: str = "1 hour") -> DataFrame:
    """Rows whose key was not written within the kept time: state is dropped behind the watermark."""
    late, _ = _watched(rows, keep, ts)
    return late.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def store_queue(batches: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand queued records to ``store`` batch by batch; offsets move only after it succeeds."""
    return batches.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
