"""Model stages on recorded responses, replayed sources and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import stages
from marlstone.plans import base
from marlstone.plans.registry import QA, RESULTS, THEOREMS, Registry
from marlstone.session import new_table_path, table
from marlstone.sources import replay
from marlstone.streaming import incremental

query = Registry()


def _recorded(df, prompt, response):
    return df.select(F.sha2(prompt, 256).alias("prompt_key"), response.alias("response"))


@query(f"WITH {QA}, g AS (SELECT theorem, min(CASE WHEN question IS NOT NULL AND answer IS NOT NULL AND is_good_qa IS NOT NULL THEN question END) AS q FROM qa WHERE theorem IS NOT NULL GROUP BY 1), {THEOREMS} SELECT t.id, g.q IS NOT NULL AS ok FROM th t LEFT JOIN g ON g.theorem = t.theorem")
def qa_generator_stage(spark, d):
    """Statements with their generated pair: replies that lack a key don't count."""
    prompt = text.prompt("Write a question for: {theorem}", theorem=F.col("theorem"))
    have = base.qa(spark, d).where("theorem is not null")
    whole = F.col("question").isNotNull() & F.col("answer").isNotNull() & F.col("is_good_qa").isNotNull()
    reply = F.to_json(F.struct("question", "answer", "is_good_qa"))
    told = have.withColumn("reply", F.when(whole, reply)).groupBy("theorem").agg(F.min("reply").alias("reply"))
    out = stages.replies(base.theorems(spark, d), prompt, _recorded(told, prompt, F.col("reply")), ["question", "answer", "is_good_qa"], "question string, answer string, is_good_qa string")
    return out.select("id", "ok")


@query(f"WITH {THEOREMS} SELECT id FROM th WHERE coalesce(lower(CASE WHEN unique_answer_explanation IS NOT NULL THEN 'true' END), 'false') <> 'false'")
def uniqueness_stage(spark, d):
    """Statements judged to have one definite answer; without a reply they go."""
    prompt = F.concat(F.lit("Is it unique? "), F.col("id").cast("string"))
    t = base.theorems(spark, d)
    told = _recorded(t.where("unique_answer_explanation is not null"), prompt, F.to_json(F.struct(F.lit("true").alias("single"), "unique_answer_explanation")))
    judged = stages.replies(t, prompt, told, ["single"], "single string")
    return stages.keep_judged(judged, F.col("reply.single"), "false", keep_failed=False).select("id")


@query(f"WITH {QA} SELECT qa_id FROM qa WHERE is_good_qa IS NULL OR lower(is_good_qa) <> 'false'")
def triviality_stage(spark, d):
    """Pairs not judged trivial; those without a reply stay."""
    prompt = F.concat(F.lit("Is it trivial? "), F.col("qa_id").cast("string"))
    q = base.qa(spark, d)
    told = _recorded(q.where("is_good_qa is not null"), prompt, F.to_json(F.struct(F.lower("is_good_qa").alias("good"))))
    judged = stages.replies(q, prompt, told, ["good"], "good string")
    return stages.keep_judged(judged, F.col("reply.good"), "false", keep_failed=True).select("qa_id")


@query(f"WITH {RESULTS} SELECT result_id, generated_answer, is_correct FROM results")
def judge_stage(spark, d):
    """Solver and judge replies joined by prompt; a verdict is true only as a boolean."""
    r = base.results(spark, d)
    key = F.col("result_id").cast("string")
    solved = stages.with_responses(r.select("result_id"), F.concat(F.lit("Solve "), key), _recorded(r, F.concat(F.lit("Solve "), key), F.col("generated_answer"))).drop("prompt_key").withColumnRenamed("response", "generated_answer")
    ask = F.concat(F.lit("Judge "), key)
    told = _recorded(r.where("is_correct is not null"), ask, F.to_json(F.struct("is_correct")))
    return stages.replies(solved, ask, told, ["is_correct"], "is_correct boolean").select("result_id", "generated_answer", F.col("reply.is_correct").alias("is_correct"))


_OUTCOME = "CASE WHEN generated_answer IS NULL OR generated_answer = 'NO_ANSWER' THEN 'SKIP' WHEN generated_answer IN ('TIMEOUT', 'ERROR') THEN generated_answer WHEN is_correct THEN 'PASS' ELSE 'FAIL' END"


@query(f"WITH {RESULTS} SELECT model, {_OUTCOME} AS outcome, count(*) AS n FROM results GROUP BY 1, 2")
def exec_results(spark, d):
    """Recorded runs by outcome."""
    return base.results(spark, d).groupBy("model", stages.outcome(F.col("generated_answer"), F.col("is_correct")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT paper_row, id FROM papers WHERE submitted_at >= TIMESTAMP '2024-02-01' AND submitted_at < TIMESTAMP '2024-03-01'")
def replay_scan(spark, d):
    """Recorded pages of a paged source, read through the data source."""
    path = new_table_path(spark, "pages")
    table(spark, d, "papers").where("submitted_at is not null").select("paper_row", "id", "category", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss").alias("submitted_at")).write.json(path)
    replay.register(spark)
    return spark.read.format("replay").option("path", path).option("first", "2024-02-01").option("last", "2024-02-29 23:59:59").load().select("paper_row", "id")


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    return incremental.stream_of(spark, path, spark.read.parquet(path).schema)


@query("SELECT id, count(*) AS n FROM (SELECT DISTINCT id FROM papers WHERE id IS NOT NULL) GROUP BY 1")
def stream_unseen(spark, d):
    """Ids worked through once, in micro-batches that remember what they saw."""
    out = new_table_path(spark, "unseen")
    incremental.unseen(_stream(spark, d, "papers").select("id"), "id", lambda b: b.select("id"), out, new_table_path(spark, "unseen-checkpoint"))
    return spark.read.parquet(f"{out}/rows").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, d):
    """One row per event within the watermark."""
    s = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.collected(incremental.deduplicated(s, ["event_id"], "ts", "40 days").select("event_id"), "dedup", "append")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, d):
    """Daily counts of a stream."""
    s = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = incremental.collected(incremental.counts_by_window(s, "ts", ["event_type"], "1 day", "1 day"), "counts", "complete")
    return out.select("event_type", F.to_date("window.start").alias("day"), "n")


QUERIES, SQL = query.queries, query.sql
