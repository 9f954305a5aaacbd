"""Shared folder, materialised steps, row identity and table access for the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings of a step: shuffle files go as soon as it has ended, since what it made is in
#: the shared folder; rows reach Python in batches of bounded size; sides of joins do not
#: pass through the driver, where every one would cost buffers and threads.
_STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a private folder is made if driver and executors are one
    process; on a cluster that is an error, since executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: the steps need a folder that all executors share")
        named = tempfile.mkdtemp(prefix="credence-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


@contextmanager
def _step(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STEP}
    for k, v in _STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: later steps survive a lost executor without the work above.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/credence/{name}-{uuid.uuid4().hex}"
    with _step(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """A table whose rows have a lasting place: itself if it is a Parquet scan, else a written copy.

    Operators that read their input twice tell its rows apart by ``row_of``: the file
    and the place in it, which do not depend on how a scan is cut into tasks, on the
    columns read or on the executors at hand.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and _format_of(plan) == "ParquetFileFormat":
        return df
    return materialise(df, "input")


def _format_of(plan) -> str:
    relation = plan.relation()
    return relation.fileFormat().getClass().getSimpleName() if relation.getClass().getSimpleName() == "HadoopFsRelation" else ""


def row_of(df: DataFrame) -> Column:
    """The lasting identity of a row of a ``stable`` table, in the order of its files: struct of file and place."""
    meta = df.metadataColumn("_metadata")
    return F.struct(F.xxhash64(meta.getField("file_path")).alias("file"), meta.getField("row_index").alias("place"))


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a table that ``materialise`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/credence/" in folder.toString():
            folder.getFileSystem(conf).delete(folder, True)


def whole_ids(docs: DataFrame, id_col: str, made: DataFrame) -> DataFrame:
    """``made`` by a Python step that was given the ids as strings, with the ids as they were: pandas would turn longs next to a null into floats."""
    return made.withColumn(id_col, F.col(f"`{id_col}`").cast(docs.schema[id_col].dataType))


def give_back() -> None:
    """Return freed memory to the system, where the allocator (glibc) can: workers that wait for a task would keep it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A-Z to a-z and nothing else; the two capitals whose lower case is ASCII or
#: starts with ASCII are first swapped for another letter outside ASCII.
def ascii_lower_for_ascii_words(text):
    """Lower case for matching words of a-z and 0-9: other letters may change, but never into ASCII."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ā")), F.lit("İ"), F.lit("ā")))
