"""Aggregations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import metrics, text
from marlstone.functions.dates import percent
from marlstone.operators import accuracy as acc
from marlstone.operators import rows
from marlstone.plans import base
from marlstone.plans.base import MONTH_SQL, TOPICS_SQL, month_of_batch
from marlstone.plans.filters import _COUNT
from marlstone.plans.joins import _PAPER_DATE, dated
from marlstone.plans.registry import QA, RESULTS, THEOREMS, Registry, norm_sql, trim_sql, words_sql

query = Registry()

_HITS = "count(*) FILTER (WHERE is_correct)"


@query(f"WITH {RESULTS} SELECT model, count(*) AS total, {_HITS} AS correct_count, round({_HITS} / count(*), 6) AS accuracy FROM results GROUP BY 1")
def accuracy(spark, d):
    return acc.accuracy(base.results(spark, d), ["model"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {RESULTS} SELECT model, CAST(floor(question_id / 1000) AS BIGINT) AS block, list(question_id ORDER BY question_id) AS correct_ids FROM (SELECT DISTINCT model, question_id FROM results WHERE is_correct) GROUP BY 1, 2")
def correct_ids(spark, d):
    """Ids answered correctly, in order, in blocks of a thousand ids: no list grows with the data."""
    block = F.floor(F.col("question_id") / 1000).alias("block")
    return base.results(spark, d).where("is_correct").groupBy("model", block).agg(F.sort_array(F.collect_set("question_id")).alias("correct_ids"))


def _levels(spark, d):
    q = base.qa(spark, d).where("batch_no is not null")
    n = sum((text.word_count(F.coalesce(c, F.lit(""))) for c in ("answer", "context")), text.word_count(F.coalesce("question", F.lit(""))))
    q = q.withColumn("topic", F.coalesce("paper_domain", F.lit("unknown"))).withColumn("long", n > 200)
    return rows.with_lookup(q, base.topics(spark).withColumnRenamed("parent", "category_main"), "topic", "category_main", text.category_prefix(F.col("topic"))).withColumn("month", month_of_batch(F.col("batch_no")))


_LEVELS = f"""{TOPICS_SQL}, {QA}, lv AS (SELECT {MONTH_SQL} AS month, coalesce(paper_domain, 'unknown') AS topic, coalesce(parent, split_part(coalesce(paper_domain, 'unknown'), '.', 1)) AS category_main, {_COUNT} > 200 AS long FROM qa LEFT JOIN topics t ON t.topic = paper_domain WHERE batch_no IS NOT NULL)"""


@query(f"WITH {_LEVELS} SELECT month, category_main, topic, count(*) AS n FROM lv GROUP BY ROLLUP (month, category_main, topic)")
def qa_rollup(spark, d):
    """Counts by month, category and topic with all totals."""
    return _levels(spark, d).rollup("month", "category_main", "topic").agg(F.count("*").alias("n")).select("month", "category_main", "topic", "n")


@query(f"WITH {_LEVELS} SELECT month, category_main, topic, count(*) FILTER (WHERE long) AS over_limit FROM lv GROUP BY ROLLUP (month, category_main, topic)")
def exceed_rollup(spark, d):
    """Records over the token limit on every level."""
    return _levels(spark, d).rollup("month", "category_main", "topic").agg(F.count_if("long").alias("over_limit")).select("month", "category_main", "topic", "over_limit")


@query(f"""WITH {_LEVELS}, leaf AS (SELECT month, category_main, topic, count(*) AS n FROM lv GROUP BY 1, 2, 3), mid AS (SELECT month, category_main, CAST(sum(n) AS BIGINT) AS total, string_agg('"' || topic || '":' || n, ',' ORDER BY topic) AS t FROM leaf GROUP BY 1, 2)
SELECT month, '{{"total":' || CAST(sum(total) AS BIGINT) || ',"categories":{{' || string_agg('"' || category_main || '":{{"total":' || total || ',"topics":{{' || t || '}}}}', ',' ORDER BY category_main) || '}}}}' AS summary FROM mid GROUP BY 1""")
def summary_json(spark, d):
    """The counts of a month as one nested JSON object, keys in order; its size is that of the topics."""
    leaf = _levels(spark, d).groupBy("month", "category_main", "topic").agg(F.count("*").alias("n"))
    mid = leaf.groupBy("month", "category_main").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("topic", "n"))).alias("t"))
    top = mid.groupBy("month").agg(F.sum("total").alias("total"), F.sort_array(F.collect_list(F.struct("category_main", "total", "t"))).alias("c"))
    entries = F.transform("c", lambda x: F.struct(x["category_main"], F.struct(x["total"].alias("total"), F.map_from_entries(x["t"]).alias("topics"))))
    return top.select("month", F.to_json(F.struct("total", F.map_from_entries(entries).alias("categories"))).alias("summary"))


def scored(spark, d):
    """Results as cloze questions of two blanks: the answer itself and its first word.

    The reply is text with markers; it is parsed, zipped with the references and scored
    blank by blank, then brought together per question, all inside one row.
    """
    r = dated(spark, d)
    first = lambda c: F.coalesce(F.try_element_at(text.words(c), F.lit(1)), F.lit(""))
    gold, said = F.coalesce("ground_truth", F.lit("")), F.coalesce("generated_answer", F.lit("NO_ANSWER"))
    reply = F.concat(F.lit("blank1: "), said, F.lit("\nblank2: "), first(said))
    r = r.withColumn("answers", text.blanks(reply, 2)).withColumn("references", F.array(gold, first(gold)))
    pairs = F.arrays_zip(F.col("references").alias("r"), F.col("answers").alias("h"))
    r = r.withColumn(
        "blanks",
        F.transform(pairs, lambda p: F.struct(metrics.exact_match(p["r"], p["h"]).alias("em"), metrics.token_f1(p["r"], p["h"]).alias("f1"), metrics.rouge_l_plain(p["r"], p["h"]).alias("rouge"), metrics.bleu(p["r"], p["h"]).alias("bleu"))),
    )
    total = lambda f: F.aggregate("blanks", F.lit(0.0), lambda a, b: a + f(b))
    n = F.size("blanks")
    hit = lambda b: metrics.binary_correct(b["em"], b["rouge"], b["bleu"])
    return r.select(
        "result_id", "model", "before_cutoff", n.cast("bigint").alias("num_blanks"),
        F.forall("blanks", lambda b: b["em"]).cast("bigint").alias("total_exact_match"),
        F.size(F.filter("blanks", lambda b: b["em"])).cast("bigint").alias("exact_blanks"),
        F.size(F.filter("blanks", hit)).cast("bigint").alias("total_binary_score"),
        total(lambda b: b["f1"]).alias("sum_f1"), (total(lambda b: b["f1"]) / n).alias("avg_f1_score"), (total(lambda b: b["rouge"]) / n).alias("avg_rouge_score"), (total(lambda b: b["bleu"]) / n).alias("avg_bleu_score"),
    )


def tokens_sql(x: str) -> str:
    return words_sql(norm_sql(x))


def f1_sql(r: str, h: str) -> str:
    a, b = f"list_distinct({tokens_sql(r)})", f"list_distinct({tokens_sql(h)})"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len(list_intersect({a}, {b})) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def grams_sql(t: str, n: int) -> str:
    return f"[array_to_string({t}[i:i+{n - 1}], chr(2)) for i in range(1, len({t}) - {n - 2})]"


def bleu_sql(rt: str, ht: str) -> str:
    """Over columns that hold the word lists."""
    parts, uni = [], ""
    for n, w in enumerate(metrics.BLEU_WEIGHTS, 1):
        rg, hg = grams_sql(rt, n), grams_sql(ht, n)
        clip = f"coalesce(list_sum([least(len(list_filter({hg}, lambda x: x = g)), len(list_filter({rg}, lambda x: x = g))) for g in list_distinct({hg})]), 0)"
        uni = clip if n == 1 else uni
        parts.append(f"{w} * ln(CASE WHEN {clip} = 0 THEN {metrics.EPSILON} ELSE CAST({clip} AS DOUBLE) END / greatest(len({hg}), 1))")
    return f"CASE WHEN {uni} = 0 THEN 0.0 ELSE exp((CASE WHEN len({ht}) > len({rt}) THEN 0.0 ELSE 1 - len({rt}) / greatest(len({ht}), 1) END) + {' + '.join(parts)}) END"


def rouge_tokens_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def lcs_sql(a: str, b: str) -> str:
    """Over columns that hold the word lists: rows of matches folded over the first list."""
    flags = f"[[CASE WHEN y = x THEN 1 ELSE 0 END for y in {b}] for x in {a}]"
    steps = f"[[j] for j in range(1, len({b}) + 1)]"
    row = f"list_reduce({steps}, lambda cur, jj: list_append(cur, CASE WHEN m[jj[1]] = 1 THEN prev[jj[1]] + 1 ELSE greatest(prev[jj[1] + 1], cur[-1]) END), [CAST(0 AS BIGINT)])"
    start = f"[CAST(0 AS BIGINT) for j in range(0, len({b}) + 1)]"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE list_reduce([list_transform(f, lambda v: CAST(v AS BIGINT)) for f in {flags}], lambda prev, m: {row}, {start})[-1] END"


_BLANKS = f"""{RESULTS}, base AS (SELECT r.result_id, r.model, coalesce({_PAPER_DATE} < c.cutoff_date, false) AS before_cutoff, coalesce(ground_truth, '') AS gold, coalesce(generated_answer, 'NO_ANSWER') AS said FROM results r LEFT JOIN model_cutoffs c ON c.model = r.model),
reply AS (SELECT *, {trim_sql("split_part(" + trim_sql("said") + ", chr(10), 1)")} AS h1, coalesce(({trim_sql("said")}), '') AS s FROM base),
pairs AS (SELECT result_id, model, before_cutoff, gold AS r, h1 AS h FROM reply UNION ALL SELECT result_id, model, before_cutoff, coalesce(list_filter(string_split_regex(gold, '[\\s\\x{{00A0}}]+'), lambda w: w <> '')[1], ''), coalesce(list_filter(string_split_regex(said, '[\\s\\x{{00A0}}]+'), lambda w: w <> '')[1], '') FROM reply),
lists AS (SELECT *, {tokens_sql('r')} AS rt, {tokens_sql('h')} AS ht, {rouge_tokens_sql('r')} AS rr, {rouge_tokens_sql('h')} AS hh FROM pairs),
uniq AS (SELECT DISTINCT r, h, rt, ht, rr, hh FROM lists),
met AS (SELECT r, h, {norm_sql('r')} = {norm_sql('h')} AS em, {f1_sql('r', 'h')} AS f1, {bleu_sql('rt', 'ht')} AS bleu, {lcs_sql('rr', 'hh')} AS lcs, len(rr) + len(hh) AS nn FROM uniq),
blank AS (SELECT p.result_id, p.model, p.before_cutoff, em, f1, bleu, CASE WHEN lcs = 0 THEN 0.0 ELSE 2.0 * lcs / nn END AS rouge FROM pairs p JOIN met USING (r, h)),
scored AS (SELECT result_id, model, before_cutoff, count(*) AS num_blanks, CAST(bool_and(em) AS BIGINT) AS total_exact_match, count(*) FILTER (WHERE em) AS exact_blanks, count(*) FILTER (WHERE em OR (rouge >= 0.8 AND bleu >= 0.5)) AS total_binary_score, sum(f1) AS sum_f1, avg(f1) AS avg_f1_score, avg(rouge) AS avg_rouge_score, avg(bleu) AS avg_bleu_score FROM blank GROUP BY 1, 2, 3)"""
_STATS = """count(*) AS questions, coalesce(CAST(sum(total_exact_match) AS BIGINT), 0) AS exact_match_questions, coalesce(round(100.0 * sum(total_exact_match) / count(*), 4), 0) AS exact_match_questions_pp, coalesce(CAST(sum(exact_blanks) AS BIGINT), 0) AS exact_match_blanks, coalesce(CAST(sum(num_blanks) AS BIGINT), 0) AS exact_match_blanks_max,
coalesce(round(100.0 * sum(exact_blanks) / sum(num_blanks), 4), 0) AS exact_match_blanks_pp, coalesce(CAST(sum(total_binary_score) AS BIGINT), 0) AS binary_points, coalesce(CAST(sum(num_blanks) AS BIGINT), 0) AS binary_max_points, coalesce(round(100.0 * sum(total_binary_score) / sum(num_blanks), 4), 0) AS binary_pp, coalesce(round(avg(avg_f1_score), 4), 0) AS avg_f1_score,
coalesce(round(sum(sum_f1) / sum(num_blanks), 4), 0) AS per_blank_avg_f1, coalesce(round(avg(avg_rouge_score), 4), 0) AS avg_rouge_l, coalesce(round(100 * avg(avg_rouge_score), 4), 0) AS rouge_l_pp, coalesce(round(avg(avg_bleu_score), 4), 0) AS avg_bleu, coalesce(round(100 * avg(avg_bleu_score), 4), 0) AS bleu_pp"""
_ROUNDED = "round(avg_f1_score, 4) AS avg_f1_score, round(avg_rouge_score, 4) AS avg_rouge_score, round(avg_bleu_score, 4) AS avg_bleu_score"


@query(f"WITH {_BLANKS} SELECT result_id, num_blanks, total_exact_match, total_binary_score, {_ROUNDED} FROM scored")
def cloze_question_agg(spark, d):
    """Scores of each question over its blanks."""
    return scored(spark, d).select("result_id", "num_blanks", "total_exact_match", "total_binary_score", *[F.round(c, 4).alias(c) for c in ("avg_f1_score", "avg_rouge_score", "avg_bleu_score")])


@query(f"WITH {_BLANKS} SELECT before_cutoff, {_STATS} FROM scored GROUP BY 1")
def cloze_segment_stats(spark, d):
    return scored(spark, d).groupBy("before_cutoff").agg(*acc.segment_columns())


@query(f"WITH {_BLANKS}, seg AS (SELECT 'before_cutoff' AS segment, {_STATS} FROM scored WHERE before_cutoff UNION ALL SELECT 'after_cutoff', {_STATS} FROM scored WHERE NOT before_cutoff UNION ALL SELECT 'overall', {_STATS} FROM scored) SELECT * FROM seg")
def cloze_grouping_sets(spark, d):
    """Before, after and overall in one pass."""
    return acc.segments(scored(spark, d))


def _gap(metric: str, column: str) -> str:
    pre, post = (f"coalesce(avg({column}) FILTER (WHERE {x}before_cutoff), 0)" for x in ("", "NOT "))
    return f"round({pre}, 4) AS {metric}_before, round({post}, 4) AS {metric}_after, round({pre} - {post}, 4) AS {metric}_gap"


@query(f"WITH {_BLANKS} SELECT model, count(*) FILTER (WHERE before_cutoff) AS n_before, count(*) FILTER (WHERE NOT before_cutoff) AS n_after, {_gap('exact', 'total_exact_match')}, {_gap('f1', 'avg_f1_score')}, {_gap('rouge', 'avg_rouge_score')}, {_gap('bleu', 'avg_bleu_score')} FROM scored GROUP BY 1")
def cutoff_gap(spark, d):
    """Each model's scores before and after its cutoff, and how much better it was before."""
    return acc.gap(scored(spark, d), ["model"], "before_cutoff", {"exact": F.col("total_exact_match"), "f1": F.col("avg_f1_score"), "rouge": F.col("avg_rouge_score"), "bleu": F.col("avg_bleu_score")})


_MONTHLY = f"monthly AS (SELECT model, strftime(evaluated_at, '%Y-%m') AS month, round(100.0 * {_HITS} / count(*), 4) AS accuracy, count(*) AS total_problems, {_HITS} AS correct_problems FROM results WHERE evaluated_at IS NOT NULL GROUP BY 1, 2)"


def _monthly(spark, d):
    r = base.results(spark, d).where("evaluated_at is not null").withColumn("month", F.date_format("evaluated_at", "yyyy-MM"))
    return acc.monthly(r, "model", "month", "is_correct")


@query(f"WITH {RESULTS}, {_MONTHLY} SELECT * FROM monthly ORDER BY model, month")
def monthly_accuracy(spark, d):
    return _monthly(spark, d).orderBy("model", "month")


@query(f"WITH {RESULTS}, {_MONTHLY} SELECT * FROM monthly")
def monthly_accuracy_detail(spark, d):
    """An empty summary, so the same is recomputed from the details."""
    detail = _monthly(spark, d)
    return acc.or_recomputed(spark.createDataFrame([], detail.schema), detail)


_TEN = [f"2024-{m:02d}" for m in range(1, 11)]
_CELLS = ", ".join(f"coalesce(max(accuracy) FILTER (WHERE month = '{m}'), 0) AS m_{m.replace('-', '_')}" for m in _TEN)


@query(f"WITH {RESULTS}, {_MONTHLY} SELECT model, {_CELLS} FROM monthly GROUP BY 1")
def model_month_pivot(spark, d):
    return acc.pivot_months(_monthly(spark, d), _TEN)


@query(f"WITH {RESULTS}, {_MONTHLY} SELECT model, round(avg(accuracy), 4) AS mean_accuracy, min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy, CAST(sum(total_problems) AS BIGINT) AS total_problems FROM monthly GROUP BY 1")
def model_summary(spark, d):
    return acc.model_summary(_monthly(spark, d))


@query(f"WITH {RESULTS} SELECT question_id, count(*) FILTER (WHERE is_correct) AS passed, coalesce(bool_and(coalesce(is_correct, false)), false) AS all_passed FROM results GROUP BY 1")
def tests_passed(spark, d):
    """Passed runs of each question, and whether all did: a question is a solution, its results are its tests."""
    ok = F.coalesce("is_correct", F.lit(False))
    return base.results(spark, d).groupBy("question_id").agg(F.count_if(ok).alias("passed"), F.every(ok).alias("all_passed"))


@query(f"WITH {QA}, {THEOREMS}, a AS (SELECT paper_id, count(*) AS n FROM th GROUP BY 1), b AS (SELECT paper_id, count(*) AS n FROM qa GROUP BY 1) SELECT a.paper_id, round(coalesce(100.0 * b.n / a.n, 0), 4) AS rate FROM a LEFT JOIN b ON a.paper_id = b.paper_id")
def retention_rate(spark, d):
    """Pairs per statement of each paper, in percent."""
    a = base.theorems(spark, d).groupBy("paper_id").agg(F.count("*").alias("a"))
    b = base.qa(spark, d).where("paper_id is not null").groupBy("paper_id").agg(F.count("*").alias("b"))
    return a.join(b, "paper_id", "left").select("paper_id", F.round(percent(F.col("b"), F.col("a")), 4).alias("rate"))


@query(f"WITH {RESULTS} SELECT model, count(*) FILTER (WHERE generated_answer NOT IN ('ERROR', 'NO_ANSWER', 'TIMEOUT')) AS ok, count(*) FILTER (WHERE generated_answer IS NULL OR generated_answer IN ('ERROR', 'NO_ANSWER', 'TIMEOUT')) AS failed FROM results GROUP BY 1")
def success_counts(spark, d):
    bad = F.col("generated_answer").isNull() | F.col("generated_answer").isin(*text.SENTINELS)
    return base.results(spark, d).groupBy("model").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"))


@query(f"WITH {THEOREMS} SELECT paper_domain, count(*) AS extracted, count(*) FILTER (WHERE unique_answer_explanation IS NOT NULL AND unique_answer_explanation <> '') AS kept FROM th GROUP BY 1")
def theorem_totals(spark, d):
    return base.theorems(spark, d).groupBy("paper_domain").agg(F.count("*").alias("extracted"), F.count_if(F.coalesce(F.col("unique_answer_explanation") != "", F.lit(False))).alias("kept"))


@query(f"""WITH {RESULTS}, last AS (SELECT * FROM results WHERE model IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id, model ORDER BY evaluated_at DESC NULLS LAST, result_id DESC) = 1)
SELECT question_id, array_to_string(list(model || '=' || coalesce(generated_answer, '') ORDER BY model), ';') AS solutions FROM last GROUP BY 1""")
def nest_solutions(spark, d):
    """Each question's last solution by model, nested."""
    last = rows.keep_first(base.results(spark, d).where("model is not null"), ["question_id", "model"], [F.col("evaluated_at").desc_nulls_last(), F.col("result_id").desc()])
    nested = last.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("model", F.coalesce("generated_answer", F.lit(""))))).alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return nested.select("question_id", F.array_join(entries, ";").alias("solutions"))


QUERIES, SQL = query.queries, query.sql
