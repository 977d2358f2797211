"""Accuracy by model, month and knowledge cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.dates import percent


def accuracy(df: DataFrame, by: Sequence[str], correct: str = "is_correct") -> DataFrame:
    """(by, total, correct_count, accuracy): null verdicts count as wrong; 0 for nothing."""
    hits = F.count_if(F.coalesce(F.col(correct), F.lit(False)))
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(F.count("*").alias("total"), hits.alias("correct_count"), F.coalesce(F.try_divide(hits, F.count("*")), F.lit(0.0)).alias("accuracy"))


def monthly(df: DataFrame, model: str, month: str, correct: str) -> DataFrame:
    """(model, month, accuracy in percent, total_problems, correct_problems)."""
    hits = F.count_if(F.coalesce(F.col(correct), F.lit(False)))
    return df.groupBy(F.col(model).alias("model"), F.col(month).alias("month")).agg(F.round(percent(hits, F.count("*")), 4).alias("accuracy"), F.count("*").alias("total_problems"), hits.alias("correct_problems"))


def or_recomputed(summary: DataFrame, detail: DataFrame) -> DataFrame:
    """The summary, or where it has no rows at all the same recomputed from details."""
    have = summary.agg(F.count("*").alias("have"))
    return summary.unionByName(detail.crossJoin(F.broadcast(have)).where("have = 0").drop("have"))  # one row


def model_summary(by_month: DataFrame) -> DataFrame:
    """Per model: unweighted mean, least and most of the monthly accuracies, and totals."""
    return by_month.groupBy("model").agg(F.round(F.avg("accuracy"), 4).alias("mean_accuracy"), F.min("accuracy").alias("min_accuracy"), F.max("accuracy").alias("max_accuracy"), F.sum("total_problems").alias("total_problems"))


def pivot_months(by_month: DataFrame, months: Sequence[str]) -> DataFrame:
    """A column per given month, 0 where a model has nothing."""
    wide = by_month.groupBy("model").pivot("month", list(months)).agg(F.first("accuracy"))
    return wide.select("model", *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias("m_" + m.replace("-", "_")) for m in months])


def before_cutoff(date: Column, cutoff: Column) -> Column:
    """Strictly before the cutoff; a model without a cutoff has nothing before it."""
    return F.coalesce(date < cutoff, F.lit(False))


def gap(df: DataFrame, by: Sequence[str], before: str, metrics: dict[str, Column]) -> DataFrame:
    """Mean of each metric before and after the cutoff, and the former minus the latter; 0 for an empty side."""
    out = []
    for name, c in metrics.items():
        pre, post = (F.coalesce(F.avg(F.when(side, c)), F.lit(0.0)) for side in (F.col(before), ~F.col(before)))
        out += [F.round(pre, 4).alias(f"{name}_before"), F.round(post, 4).alias(f"{name}_after"), F.round(pre - post, 4).alias(f"{name}_gap")]
    return df.groupBy(*by).agg(F.count_if(F.col(before)).alias("n_before"), F.count_if(~F.col(before)).alias("n_after"), *out)


#: The statistics of a segment, in order.
SEGMENT_STATS = ("questions", "exact_match_questions", "exact_match_questions_pp", "exact_match_blanks", "exact_match_blanks_max", "exact_match_blanks_pp", "binary_points", "binary_max_points", "binary_pp", "avg_f1_score", "per_blank_avg_f1", "avg_rouge_l", "rouge_l_pp", "avg_bleu", "bleu_pp")


def segment_columns() -> list[Column]:
    """The statistics over rows of scored questions (see ``plans.cloze.scored``)."""
    n, blanks = F.count("*"), F.coalesce(F.sum("num_blanks"), F.lit(0))
    em_q, em_b, points = (F.coalesce(F.sum(c), F.lit(0)) for c in ("total_exact_match", "exact_blanks", "total_binary_score"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    values = [
        n, em_q, percent(em_q, n), em_b, blanks, percent(em_b, blanks), points, blanks, percent(points, blanks),
        mean("avg_f1_score"), F.coalesce(F.try_divide(F.sum("sum_f1"), F.sum("num_blanks")), F.lit(0.0)), mean("avg_rouge_score"), mean("avg_rouge_score") * 100, mean("avg_bleu_score"), mean("avg_bleu_score") * 100,
    ]
    whole = {"questions", "exact_match_questions", "exact_match_blanks", "exact_match_blanks_max", "binary_points", "binary_max_points"}
    return [(v.cast("bigint") if s in whole else F.round(v, 4)).alias(s) for s, v in zip(SEGMENT_STATS, values)]


def segments(scored: DataFrame, before: str = "before_cutoff") -> DataFrame:
    """before_cutoff, after_cutoff and overall in one pass; a segment without questions has zeros."""
    spark = scored.sparkSession
    grouped = (
        scored.groupingSets([[F.col(before)], []], F.col(before)).agg(F.grouping(before).alias("all"), *segment_columns())
        .withColumn("segment", F.when(F.col("all") == 1, "overall").when(F.col(before), "before_cutoff").otherwise("after_cutoff"))
        .drop(before, "all")
    )
    names = spark.createDataFrame([("before_cutoff",), ("after_cutoff",), ("overall",)], "segment string")
    return names.join(grouped, "segment", "left").select("segment", *[F.coalesce(s, F.lit(0)).alias(s) for s in SEGMENT_STATS])
