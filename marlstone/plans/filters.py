"""Predicates and projections as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import rows
from marlstone.plans import base
from marlstone.plans.registry import QA, RESULTS, THEOREMS, Registry, trim_sql, words_sql
from marlstone.session import table

query = Registry()


@query("SELECT paper_row, coalesce(category = 'math.CO', false) AS is_sub, coalesce(starts_with(category, 'math.'), false) AS is_main FROM papers")
def primary_category(spark, d):
    c = F.col("category")
    return table(spark, d, "papers").select("paper_row", F.coalesce(text.in_category(c, "math.CO", True), F.lit(False)).alias("is_sub"), F.coalesce(text.in_category(c, "math", False), F.lit(False)).alias("is_main"))


@query(f"SELECT doc_id FROM documents WHERE length({trim_sql('text')}) > 0")
def nonempty_text(spark, d):
    return table(spark, d, "documents").where(text.is_nonempty(F.col("text"))).select("doc_id")


_VERDICT = """CASE id % 5 WHEN 0 THEN '{"single_unique_answer": "true"}' WHEN 1 THEN '{"single_unique_answer": "False"}' WHEN 2 THEN '{"single_unique_answer": false}' WHEN 3 THEN '{"explanation": "none"}' ELSE '{"single_unique' END"""


@query(f"""WITH {THEOREMS}, v AS (SELECT id, CASE WHEN json_valid(r) THEN lower(json_extract_string(r, '$.single_unique_answer')) END AS verdict FROM (SELECT id, {_VERDICT} AS r FROM th)) SELECT id, verdict FROM v WHERE coalesce(verdict, 'false') <> 'false'""")
def unique_answer_filter(spark, d):
    """Statements that the judge's reply gives a single definite answer; false as a text or a boolean, a missing verdict and an unreadable reply drop them."""
    kinds = ['{"single_unique_answer": "true"}', '{"single_unique_answer": "False"}', '{"single_unique_answer": false}', '{"explanation": "none"}', '{"single_unique']
    reply = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 5 + 1).cast("int"))
    verdict = F.lower(F.try_variant_get(F.try_parse_json(reply), "$.single_unique_answer", "string"))
    return base.theorems(spark, d).select("id", verdict.alias("verdict")).where(F.coalesce("verdict", F.lit("false")) != "false")


@query(f"WITH {QA} SELECT qa_id FROM qa WHERE is_good_qa = 'true' AND length({trim_sql('question')}) > 0 AND length({trim_sql('answer')}) > 0")
def qa_gate(spark, d):
    """Pairs said to be good, with a question and an answer."""
    return base.qa(spark, d).where((F.col("is_good_qa") == "true") & text.is_nonempty(F.col("question")) & text.is_nonempty(F.col("answer"))).select("qa_id")


@query(f"WITH {QA} SELECT qa_id, CAST(floor(length(context) / 4) AS BIGINT) AS tokens FROM qa WHERE floor(length(coalesce(context, '')) / 4) <= 100 AND context IS NOT NULL")
def length_guard(spark, d):
    """Contexts of at most 100 estimated tokens."""
    n = text.token_estimate(F.col("context"))
    return base.qa(spark, d).where(n <= 100).select("qa_id", n.cast("bigint").alias("tokens"))


@query(f"""WITH {QA}, judged AS (SELECT paper_link, lower(min(is_good_qa)) AS v FROM qa GROUP BY 1)
SELECT q.qa_id FROM qa q LEFT JOIN judged j ON j.paper_link = q.paper_link WHERE coalesce(CASE WHEN j.v IN ('false', 'no', '0') THEN 'true' ELSE 'false' END, 'false') <> 'true'""")
def trivial_filter(spark, d):
    """Pairs that their paper's judge does not call trivial; without a verdict they stay."""
    q = base.qa(spark, d)
    judged = q.groupBy("paper_link").agg(F.lower(F.min("is_good_qa")).alias("v"))
    trivial = F.when(F.col("v").isin("false", "no", "0"), "true").otherwise("false")
    return q.join(judged, "paper_link", "left").where(F.coalesce(trivial, F.lit("false")) != "true").select("qa_id")


@query(f"WITH {RESULTS} SELECT result_id FROM results WHERE generated_answer NOT IN ('ERROR', 'NO_ANSWER', 'TIMEOUT')")
def drop_error_rows(spark, d):
    return base.results(spark, d).where(~F.col("generated_answer").isin(*text.SENTINELS)).select("result_id")


@query(f"WITH {RESULTS} SELECT generated_answer IS NULL OR generated_answer IN ('ERROR', 'NO_ANSWER', 'TIMEOUT') AS failed, count(*) AS n FROM results GROUP BY 1")
def error_partition(spark, d):
    """Failed and usable results counted."""
    g = F.col("generated_answer")
    return base.results(spark, d).groupBy((g.isNull() | g.isin(*text.SENTINELS)).alias("failed")).agg(F.count("*").alias("n"))


_CLOZE = "regexp_replace(regexp_replace(item_text, '\\[blank_1\\]', '[blank1]', 'g'), '\\[blank_2\\]', '[blank2]', 'g')"
_PARTS = f"list_slice({words_sql('item_text')}, 1, 2)"


@query(f"""SELECT item_id, contains(lower({_CLOZE}), '[blank1]') AND contains(lower({_CLOZE}), '[blank2]') AND len(list_filter({_PARTS}, lambda a: length(a) <= 1)) = 0 AND len({_PARTS}) = 2 AS valid FROM eval_items""")
def cloze_valid(spark, d):
    """Whether an item with its first two words as answers is a valid cloze question."""
    t = F.col("item_text")
    question = F.regexp_replace(F.regexp_replace(t, r"\[blank_1\]", "[blank1]"), r"\[blank_2\]", "[blank2]")
    answers = F.slice(text.words(t), 1, 2)
    return table(spark, d, "eval_items").select("item_id", (text.cloze_is_valid(question, answers, 1, 5) & (F.size(answers) == 2)).alias("valid"))



@query("SELECT doc_id FROM documents WHERE year_month IS NOT NULL AND (try_strptime(year_month || '-01', '%Y-%m-%d') IS NULL OR try_strptime(year_month || '-01', '%Y-%m-%d') BETWEEN TIMESTAMP '2023-05-01' AND TIMESTAMP '2024-02-29')")
def date_range_filter(spark, d):
    """Documents of a range of dates: unreadable dates stay, missing ones go, and if none is left all count."""
    docs = table(spark, d, "documents")
    day = F.try_to_date(F.concat("year_month", F.lit("-01")), "yyyy-MM-dd")
    kept = docs.where(F.col("year_month").isNotNull() & (day.isNull() | day.between(F.lit("2023-05-01").cast("date"), F.lit("2024-02-29").cast("date"))))
    return (kept if kept.take(1) else docs).select("doc_id")


_COUNT = f"len({words_sql('coalesce(question, chr(32))')}) + len({words_sql('coalesce(answer, chr(32))')}) + len({words_sql('coalesce(context, chr(32))')})"


@query(f"WITH {QA} SELECT qa_id, {_COUNT} AS tokens, {_COUNT} > 200 AS over_limit FROM qa")
def token_limit(spark, d):
    """Tokens (words) of question, answer and context against a limit; any count and limit can be given."""
    return rows.token_guard(base.qa(spark, d), ["question", "answer", "context"], text.word_count, 200).select("qa_id", "tokens", "over_limit")


@query("SELECT event_type, round(avg(CASE WHEN value > 0 THEN value END), 4) AS mean, min(CASE WHEN value > 0 THEN value END) AS low, max(CASE WHEN value > 0 THEN value END) AS high FROM events GROUP BY 1")
def positive_stats(spark, d):
    """Statistics of strictly positive values; zeros count as missing."""
    v = F.when(F.col("value") > 0, F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("SELECT id AS paper_id, category AS paper_domain, citations AS paper_citations, paper_link FROM papers")
def project_rename(spark, d):
    return table(spark, d, "papers").select(F.col("id").alias("paper_id"), F.col("category").alias("paper_domain"), F.col("citations").alias("paper_citations"), "paper_link")


@query("SELECT text_row, coalesce(nullif(title, ''), nullif(id, ''), nullif(paper_link, ''), 'N/A') AS shown FROM latex_text")
def field_fallback(spark, d):
    return table(spark, d, "latex_text").select("text_row", F.coalesce(text.first_nonempty(F.col("title"), F.col("id"), F.col("paper_link")), F.lit("N/A")).alias("shown"))


@query(f"WITH {RESULTS} SELECT result_id, left(question, 100) AS question, left(ground_truth, 150) AS ground_truth, left(generated_answer, 200) AS generated_answer FROM results")
def truncate_fields(spark, d):
    return base.results(spark, d).select("result_id", *[text.preview(F.col(c), n).alias(c) for c, n in (("question", 100), ("ground_truth", 150), ("generated_answer", 200))])


@query(f"WITH {QA} SELECT qa_id, 'Context: ' || coalesce(context, '') || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer:' AS prompt FROM qa")
def render_prompt(spark, d):
    return base.qa(spark, d).select("qa_id", text.prompt("Context: {context}\nQuestion: {question}\nAnswer:", context=F.col("context"), question=F.col("question")).alias("prompt"))


@query("SELECT paper_row, 'Title: ' || coalesce(title, '') || chr(10) || 'Mark [blank1], [blank2], [blank3] and give answer1, answer2, answer3.' AS prompt FROM papers")
def cloze_prompt(spark, d):
    """A prompt that asks for three blanks; the list of markers is made from their number."""
    def each(kind):
        return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit(kind[0]), i.cast("string"), F.lit(kind[1])))

    made = text.prompt("Title: {title}\nMark {marks} and give {answers}.", title=F.col("title"), marks=F.array_join(each(("[blank", "]")), ", "), answers=F.array_join(each(("answer", "")), ", "))
    return table(spark, d, "papers").select("paper_row", made.alias("prompt"))


@query("SELECT doc_id, len(" + words_sql("coalesce(text, '')") + ") AS n FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.coalesce("text", F.lit(""))).alias("n"))


@query("SELECT part.p_partkey, translate(p_name, 'abc', 'XYZ') AS perturbed, translate(p_type, '/-', '__') AS safe FROM part")
def perturb_map(spark, d):
    return table(spark, d, "part").select("p_partkey", text.perturbed(F.col("p_name")).alias("perturbed"), text.file_safe(F.col("p_type")).alias("safe"))


@query("SELECT paper_row, translate(paper_link, '/-', '__') AS safe FROM papers")
def sanitize(spark, d):
    return table(spark, d, "papers").select("paper_row", text.file_safe(F.col("paper_link")).alias("safe"))


@query("SELECT paper_row, split_part(string_split(id, '/')[-1], 'v', 1) AS short_id, split_part(category, '.', 1) AS main FROM papers")
def strip_version(spark, d):
    return table(spark, d, "papers").select("paper_row", text.without_version(F.col("id")).alias("short_id"), text.category_prefix(F.col("category")).alias("main"))


@query(f"WITH {QA} SELECT qa_id, {trim_sql('lower(question)')} AS question FROM qa")
def normalize_text(spark, d):
    return base.qa(spark, d).select("qa_id", text.normalized(F.col("question")).alias("question"))


QUERIES, SQL = query.queries, query.sql
