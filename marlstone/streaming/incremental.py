"""Incremental processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.session import new_table_path


def stream_of(spark: SparkSession, path: str, schema, files_at_once: int = 1000) -> DataFrame:
    """A file stream over a Parquet table, a folder or one file. As a pattern, for a path without one must be a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(query) -> None:
    """Work through all there is, then stop."""
    query.awaitTermination()


def unseen(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply ``work`` to rows whose key has not been seen, also by earlier runs; keys are remembered even if they yield nothing.

    Keys seen are the stream's state, partitioned by key: a micro-batch looks at the state of its own
    keys. Results go to ``out/rows``. A micro-batch is written under its number and overwrites itself,
    so one repeated after a failure changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    fresh = stream.where(F.col(key).isNotNull()).dropDuplicates([key])
    run_available(fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """One row per key among rows at most ``late`` apart; the state of older keys is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts_by_window(stream: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def collected(result: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result: complete results replace each other, appended ones add up."""
    spark = result.sparkSession
    out, checkpoint = new_table_path(spark, name), new_table_path(spark, name + "-checkpoint")
    if mode == "append":
        q = result.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        q = result.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).outputMode(mode)
    run_available(q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return spark.read.schema(result.schema).parquet(out)
