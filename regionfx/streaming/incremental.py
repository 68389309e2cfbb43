"""Scoring that can be stopped and run again: each batch of keys is in the output once, whatever was cut off.

A table of results is a folder with ``rows/batch=<id>``, ``keys/batch=<id>`` and ``batches/batch=<id>``, written in this order, each by
replacing what an earlier try of the same batch has left.  The last is the manifest: rows and keys of a batch count
once it is there, and what a stopped run has written without it is replaced by the next run.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from regionfx.operators.sampling import hash_order, numbered
from regionfx.storage import exists, materialize, scratch

ROWS, KEYS, BATCHES = "rows", "keys", "batches"


def _read(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of the output with its column ``batch``, of finished batches only."""
    done = spark.read.parquet(f"{path}/{BATCHES}").select(F.col("batch").alias("_done")).distinct()
    rows = spark.read.parquet(f"{path}/{part}")
    return rows.join(done, F.col("batch") == F.col("_done"), "left_semi")


def read_finished(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished batches; the output must have one."""
    return _read(spark, path, ROWS).drop("batch")


def finished_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The keys of finished batches, null among them if it was scored; None before the first."""
    return _read(spark, path, KEYS).select(key) if exists(spark, f"{path}/{BATCHES}") else None


def write_batch(spark: SparkSession, path: str, batch: str, rows: DataFrame, keys: DataFrame, partition_by: list[str] | None = None) -> None:
    """Write a batch's rows and keys, then say that it is finished.  The same id again replaces the batch."""
    to = lambda df, part: df.write.mode("overwrite").parquet(f"{path}/{part}/batch={batch}")
    writer = rows.hint("rebalance", *partition_by).write.partitionBy(*partition_by) if partition_by else rows.write
    writer.mode("overwrite").parquet(f"{path}/{ROWS}/batch={batch}")
    to(keys, KEYS)
    to(spark.range(1), BATCHES)


def incremental_scoring(df: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], path: str, keys_per_batch: int | None = None, partition_by: list[str] | None = None) -> int:
    """Score the keys that no finished batch holds; the number of new keys, the null key among them.

    With ``keys_per_batch`` keys are scored in batches of that size, each finished before the next, so a stopped run loses
    one batch's work.  A key is in one batch, also if scoring gives no rows for it.
    """
    spark = df.sparkSession
    with scratch(spark):
        keys = df.select(key).distinct()
        done = finished_keys(spark, path, key)
        if done is not None:
            own = done.distinct().withColumnRenamed(key, "_key")
            keys = keys.join(own, keys[key].eqNullSafe(own["_key"]), "left_anti")
        placed = keys.withColumn("_h", hash_order(key, 0))
        placed = numbered(placed, ["_h", key], "_n").drop("_h") if keys_per_batch else keys.withColumn("_n", F.lit(1).cast("long"))
        todo = materialize(placed.withColumn("_b", F.floor((F.col("_n") - 1) / (keys_per_batch or 1)).cast("long")), "todo")
        n, first = todo.count(), 0
        if done is not None:
            last = spark.read.parquet(f"{path}/{BATCHES}").where("batch LIKE 'run-%'").agg(F.max("batch")).first()[0]
            first = int(last[4:]) + 1 if last else 0
        for b in range(-(-n // keys_per_batch) if keys_per_batch else min(n, 1)):
            own = todo.where(F.col("_b") == b).select(F.col(key).alias("_key"))
            rows = df.join(own, df[key].eqNullSafe(own["_key"]), "left_semi")
            write_batch(spark, path, f"run-{first + b:012d}", score(rows), own.withColumnRenamed("_key", key), partition_by)
    return n


def stream_scoring(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str | None = None) -> None:
    """Score all files that came since the last run, then stop; files are taken once, by the stream's checkpoint.

    A batch that is repeated after a failure has the id that it had, and replaces what it wrote.  With ``key`` its keys count
    as scored for ``incremental_scoring`` into the same folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        keys = batch.select(key).distinct() if key else spark.createDataFrame([], StructType([StructField("_none", LongType())]))
        write_batch(batch.sparkSession, path, f"stream-{number:012d}", score(batch), keys)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def by_key_mean(key: str, value: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(key).agg(F.avg(value).alias("score"))
