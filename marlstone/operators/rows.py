"""Keeping, matching and numbering rows."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import materialise

#: Tables up to this many rows and bytes (as JSON) may be broadcast as dimensions.
DIMENSION_ROWS, DIMENSION_BYTES = 10_000, 16 << 20


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key. Spark keeps the first ``n`` per task before the shuffle, so hot keys stay small; nulls are a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the processed ids; null keys count as not processed."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def processed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_semi")


def dimension(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is small; its rows and bytes are counted, never assumed."""
    told = df.limit(DIMENSION_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if told["n"] <= DIMENSION_ROWS and told["bytes"] <= DIMENSION_BYTES else df


def with_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``df`` with ``value`` looked up by ``key``, or the default."""
    d = dimension(dim.select(key, F.col(value).alias("_value")).dropDuplicates([key]))
    return df.join(d, key, "left").withColumn(value, F.coalesce("_value", default)).drop("_value")


def for_each_model(df: DataFrame, models: DataFrame) -> DataFrame:
    """Every row with every model; the models are a small, counted dimension."""
    return df.crossJoin(dimension(models))


def with_responses(df: DataFrame, prompt: Column, responses: DataFrame) -> DataFrame:
    """Rows with their recorded response, matched by the SHA-256 of the prompt; null where there is none.

    ``responses`` has (prompt_key, response); the least response counts where a prompt was asked twice.
    """
    one = responses.groupBy("prompt_key").agg(F.min("response").alias("response"))
    return df.withColumn("prompt_key", F.sha2(prompt, 256)).join(one, "prompt_key", "left")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "index") -> DataFrame:
    """A running number from 1 within each group; for groups of bounded size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def numbered_wide(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "index") -> DataFrame:
    """``numbered`` for groups of any size: a group is spread over range partitions, and each starts after those before it.

    Written to the shared folder once, so that the partitions counted are those numbered.
    Nulls are a group of their own and come first in the order; ``order`` must be unique
    within a group for the numbers to be reproducible.
    """
    placed = materialise(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    # a row per group and partition
    before = sizes.select(F.col("_part").alias("_p"), *[F.col(c).alias("_g_" + c) for c in by], (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col("_g_" + c))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    return placed.join(before, same).withColumn(name, number).select(*df.columns, name)


def batches(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Fixed-size batches within each group, numbered from 0."""
    return numbered_wide(df, by, order, "_k").withColumn("batch", F.floor((F.col("_k") - 1) / size)).drop("_k")


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows in an order that depends only on the key and the seed. Spark takes the first ``n`` of each task."""
    return df.withColumn("draw", F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))).orderBy("draw", key).limit(n)


def token_guard(df: DataFrame, columns: Sequence[str], count: Callable[[Column], Column], limit: int) -> DataFrame:
    """``df`` with ``tokens``, the sum of ``count`` over the columns (nulls have none), and ``over_limit``. ``count`` may be any tokenizer's: see ``functions.text`` and ``functions.tokens``."""
    total = functools.reduce(lambda a, b: a + b, [count(F.coalesce(c, F.lit(""))) for c in columns])
    return df.withColumn("tokens", total).withColumn("over_limit", F.col("tokens") > limit)


def append(old: DataFrame, new: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Old and new rows; with ``keys``, only the first row per key, old before new."""
    if keys is None:
        return old.unionByName(new)
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_first(both, keys, [F.col("_new")]).drop("_new")
