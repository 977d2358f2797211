"""Joining rows that share a key, in units of bounded size.

Similarity joins first bring together all rows that share a bucket or a token
(a *unit*) and then look at the pairs inside. Units are unevenly large: one may
hold a third of all rows. ``split_hot`` cuts the large ones into blocks and
sends every pair of blocks to a task of its own, so no task holds more than
``2 * limit`` rows of a unit and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs held at once while a unit is worked through.
PAIRS_AT_ONCE = 1 << 20


def split_hot(rows: DataFrame, limit: int) -> DataFrame:
    """Add ``role`` to ``rows`` (columns ``unit``, ``id`` and payload), with large units cut into pairs of blocks.

    role 0: every pair in the unit counts; roles 1 and 2: only pairs of a 1 and a 2.
    ``rows`` should be cheap to read twice. A unit's size is counted by a map-side
    combined aggregate over its keys alone; without large units nothing is joined.
    """
    hot = rows.groupBy("unit").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    if not hot.take(1):
        return rows.withColumn("role", F.lit(0))
    marked = rows.join(hot, "unit", "left").withColumn("_g", F.ceil(F.coalesce("_n", F.lit(0)) / limit).cast("int"))
    cold = marked.where(F.col("_g") <= 1).withColumn("role", F.lit(0))
    block = F.pmod(F.xxhash64("id", F.lit(11)), F.col("_g")).cast("int")
    big = (
        marked.where(F.col("_g") > 1)
        .withColumn("_b", block)
        .withColumn("_j", F.explode(F.expr("sequence(0, _g - 1)")))
        .withColumn("role", F.when(F.col("_b") == F.col("_j"), 0).when(F.col("_b") < F.col("_j"), 1).otherwise(2))
        .withColumn("unit", F.xxhash64("unit", F.least("_b", "_j"), F.greatest("_b", "_j")))
    )
    names = [*rows.columns, "role"]
    return cold.select(names).unionByName(big.select(names))


#: Rows of a key that one task joins; keys with more are spread.
SPREAD = 1_000_000


def join_classes(rows: DataFrame, classes: DataFrame, on: list[str], largest: int | None = None, limit: int = SPREAD) -> DataFrame:
    """``rows`` joined to ``classes``, which has one row per key with the ``size`` of the key in ``rows`` (dropped here).

    Keys of more than ``limit`` rows are spread over tasks, each with a copy of the class.
    ``largest``: the greatest size, where it is known already.
    """
    if largest is None:
        largest = classes.agg(F.max("size")).first()[0] or 0
    if largest <= limit:
        return rows.join(classes.drop("size"), on)
    copies = F.ceil(F.col("size") / limit).cast("int")
    hot = classes.where(F.col("size") > limit).select(*on, copies.alias("_copies"))
    # hot keys are no more than the rows divided by the limit
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_copy", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_copies")).cast("int"), F.lit(0))).drop("_copies")
    right = classes.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))).drop("size")
    return left.join(right, [*on, "_copy"]).drop("_copy")


def each_unit(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, rows_at_once: int = 200_000) -> DataFrame:
    """Apply ``work`` to Arrow tables that hold whole units only, sorted by unit.

    Rows stream through in sorted order; a table has about ``rows_at_once`` rows,
    or one unit where that is larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < rows_at_once:
                continue
            whole = pa.Table.from_batches(held)
            unit = whole["unit"].to_numpy()
            cut = int(np.searchsorted(unit, unit[-1], side="left"))
            if cut:
                yield from work(whole.slice(0, cut).combine_chunks())
                whole = whole.slice(cut)
            held, size = whole.to_batches(), whole.num_rows
        if size:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def runs_of(keys: np.ndarray) -> np.ndarray:
    """For ascending keys: the end (exclusive) of the run that each position is in."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.append(heads[1:], n)
    return np.repeat(ends, ends - heads)


def pairs_in_runs(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All position pairs (i < j) with equal ascending keys, in arrays of bounded size."""
    end = runs_of(keys)
    active = np.flatnonzero(end - np.arange(len(keys)) > 1)
    lag, left, right, held = 1, [], [], 0
    while len(active):
        left.append(active)
        right.append(active + lag)
        held += len(active)
        if held >= PAIRS_AT_ONCE:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
        lag += 1
        active = active[end[active] - active > lag]
    if held:
        yield np.concatenate(left), np.concatenate(right)
