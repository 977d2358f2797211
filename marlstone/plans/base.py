"""The tables with rows that were delivered twice counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.rows import keep_first
from marlstone.session import table

#: Fixed value: topics that stand for several.
PARENTS = {"physics": ("gr-qc", "math-ph", "nlin.SI", "physics.comp-ph", "physics.flu-dyn")}


def results(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "eval_results"), ["result_id"], [F.col("evaluated_at").asc_nulls_last()])


def qa(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "qa_pairs"), ["qa_id"], [F.col("ingested_at").asc_nulls_last()])


def theorems(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(table(spark, d, "theorems"), ["id"], [F.col("paper_id").asc_nulls_last()])


def topics(spark: SparkSession) -> DataFrame:
    """(topic, parent): the small topic dimension."""
    rows = [(p, p) for p in PARENTS] + [(s, p) for p, subs in PARENTS.items() for s in subs]
    return spark.createDataFrame(rows, "topic string, parent string")


TOPICS_SQL = "topics(topic, parent) AS (VALUES " + ", ".join(f"('{t}', '{p}')" for p, subs in PARENTS.items() for t in (p, *subs)) + ")"


def month_of_batch(c):
    """The month of a batch number: 1 is July 2023."""
    return F.date_format(F.add_months(F.lit("2023-07-01").cast("date"), c - 1), "yyyy-MM")


MONTH_SQL = "strftime(DATE '2023-07-01' + to_months(batch_no - 1), '%Y-%m')"
