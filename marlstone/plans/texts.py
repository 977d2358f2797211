"""LaTeX, replies, metrics, dates and JSON as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates, latex, metrics, text, values
from marlstone.plans import base
from marlstone.plans.aggregates import bleu_sql, f1_sql, lcs_sql, rouge_tokens_sql, tokens_sql
from marlstone.plans.joins import _PLACES, _STATEMENTS
from marlstone.plans.registry import QA, RESULTS, WS, Registry, norm_sql, trim_sql
from marlstone.session import table

query = Registry()


def _texts(spark, d):
    return table(spark, d, "latex_text").where("full_text is not null")


def _stripped_sql(lines: str, glue: str) -> str:
    """The state machine as a window: a line is inside if the last marker before it opened."""
    markers = r"least(nullif(strpos(line, '\begin{comment}'), 0), nullif(strpos(line, '\iffalse'), 0))"
    closed = r"greatest(CASE WHEN contains(line, '\end{comment}') THEN strpos(line, '\end{comment}') + 12 END, CASE WHEN contains(line, '\fi') THEN strpos(line, '\fi') + 2 END)"
    head = "left(line, strpos(line, '%') - 1)"
    odd = lambda x: f"({x}) % 2 = 1"
    kept = rf"{odd(f"length({head}) - length(rtrim({head}, chr(92)))")} OR {odd(f"length({head}) - length(replace({head}, '$', ''))")} OR ends_with({head}, '\{{')"
    return f"""WITH split AS (SELECT text_row, {lines} AS ls FROM latex_text WHERE full_text IS NOT NULL), l AS (SELECT text_row, i, ls[i] AS line FROM split, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
m AS (SELECT *, {markers} AS opened, {closed} AS closed FROM l), e AS (SELECT *, CASE WHEN opened IS NOT NULL THEN true WHEN closed IS NOT NULL THEN false END AS event FROM m),
st AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY text_row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM e),
o AS (SELECT text_row, i, CASE WHEN opened IS NOT NULL THEN nullif(left(line, opened - 1), '') WHEN closed IS NOT NULL THEN nullif(substr(line, closed + 1), '') WHEN inside OR regexp_matches(line, '^{WS}*%') THEN NULL WHEN contains(line, '%') AND NOT ({kept}) THEN {head} ELSE line END AS kept FROM st)
SELECT s.text_row, md5(coalesce(string_agg(kept, {glue} ORDER BY i), '')) AS digest FROM split s LEFT JOIN o ON o.text_row = s.text_row GROUP BY 1"""


@query(_stripped_sql(r"regexp_extract_all(replace(replace(full_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[^\n]*\n|[^\n]+')", "''"))
def strip_comments(spark, d):
    """Comments removed by the line-state machine."""
    return _texts(spark, d).select("text_row", F.md5(latex.strip_comments("full_text")).alias("digest"))


@query(_stripped_sql("string_split(full_text, chr(10))", "chr(10)"))
def strip_comments_text(spark, d):
    return _texts(spark, d).select("text_row", F.md5(latex.strip_comments_text("full_text")).alias("digest"))


@query(r"SELECT text_row, md5(regexp_replace(replace(regexp_replace(replace(full_text, '\%', chr(1)), '%[^\n]*(?:\n|\z)', chr(10), 'g'), chr(1), '\%'), '\n\s*\n+', chr(10) || chr(10), 'g')) AS digest FROM latex_text WHERE full_text IS NOT NULL")
def remove_comments_regex(spark, d):
    return _texts(spark, d).select("text_row", F.md5(latex.remove_comments(F.col("full_text"))).alias("digest"))


_APPENDIX = "least(" + ", ".join(f"CASE WHEN regexp_matches(full_text, '{p}', 'i') THEN strpos(full_text, regexp_extract(full_text, '{p}', 0, 'i')) END" for p in latex.APPENDIX) + ")"


@query(f"SELECT text_row, md5(CASE WHEN {_APPENDIX} IS NULL THEN full_text ELSE left(full_text, {_APPENDIX} - 1) END) AS digest FROM latex_text WHERE full_text IS NOT NULL")
def truncate_appendix(spark, d):
    """The text before the first sign of an appendix."""
    return _texts(spark, d).select("text_row", F.md5(latex.without_appendix(F.col("full_text"))).alias("digest"))


@query("SELECT text_row, regexp_matches(full_text, '" + "|".join(latex.SECTION_NUMBERING) + "') AS by_section FROM latex_text WHERE full_text IS NOT NULL")
def section_numbering(spark, d):
    return _texts(spark, d).select("text_row", latex.numbered_by_section(F.col("full_text")).alias("by_section"))


@query(f"WITH {_PLACES} SELECT text_row, position, title FROM sec")
def sections(spark, d):
    s = _texts(spark, d).select("text_row", F.explode(latex.sections(F.col("full_text"))).alias("s"))
    return s.select("text_row", "s.position", "s.title")


# a section's number: its own if the title tells one above 0, else one more than the section before
@query(f"""WITH RECURSIVE {_PLACES}, told AS (SELECT text_row, place, try_cast(nullif(regexp_extract(title, '^(\\d{{1,9}})[.\\s]+', 1), '') AS INTEGER) AS t FROM sec),
numbered AS (SELECT text_row, place, CASE WHEN t > 0 THEN t ELSE 1 END AS number FROM told WHERE place = 1 UNION ALL SELECT t.text_row, t.place, CASE WHEN t.t > 0 THEN t.t ELSE n.number + 1 END FROM numbered n JOIN told t ON t.text_row = n.text_row AND t.place = n.place + 1)
SELECT text_row, place, number FROM numbered""")
def section_numbers(spark, d):
    s = _texts(spark, d).select("text_row", F.posexplode(latex.sections(F.col("full_text"))).alias("i", "s"))
    return s.select("text_row", (F.col("i") + 1).cast("bigint").alias("place"), "s.number")


@query(r"""WITH e AS (SELECT text_row, unnest(regexp_extract_all(full_text, '\\newtheorem\{([^}]+)\}\{([^}]+)\}', 1)) AS env, unnest(regexp_extract_all(full_text, '\\newtheorem\{([^}]+)\}\{([^}]+)\}', 2)) AS shown FROM latex_text WHERE full_text IS NOT NULL)
SELECT DISTINCT text_row, env FROM e WHERE contains(lower(env), 'theorem') OR contains(lower(shown), 'theorem')""")
def theorem_envs(spark, d):
    return _texts(spark, d).select("text_row", F.explode(latex.theorem_environments(F.col("full_text"))).alias("env"))


_BODY = r"regexp_extract(body, '(?s)^\\begin\{[a-z]+\}(.*)\\end\{[a-z]+\}$', 1)"
_CONTENT = rf"regexp_replace(regexp_replace(regexp_replace({_BODY}, '^\[[^\]]+\]', ''), '\\label\{{(.*?)\}}', '', 'g'), '^\s+|\s+$', '', 'g')"


def _statements(spark, d):
    return _texts(spark, d).select("text_row", "full_text", F.explode(latex.statements(F.col("full_text"))).alias("s")).select("text_row", "full_text", "s.*")


@query(rf"WITH {_STATEMENTS} SELECT text_row, start, trim(regexp_extract({_BODY}, '^\[([^\]]+)\]', 1)) AS number, md5({_CONTENT}) AS content FROM st WHERE regexp_matches({_BODY}, '^\[([^\]]+)\]')")
def theorems_numbered(spark, d):
    """Statements that carry their number."""
    return _statements(spark, d).where("number is not null").select("text_row", "start", "number", F.md5("content").alias("content"))


_NEAR = "substr(full_text, greatest(start - 1000, 0) + 1, start + length(body) + 1000 - greatest(start - 1000, 0))"
_LABELLED = rf"nullif(regexp_extract({_BODY}, '\\label\{{(.*?)\}}', 1), '')"
_TOLD = ", ".join(f"nullif(regexp_extract({_NEAR}, '{p}', 1), '')" for p in latex.NUMBERS)


_NUMBERED_SECTIONS = """told AS (SELECT text_row, place, position, try_cast(nullif(regexp_extract(title, '^(\\d{1,9})[.\\s]+', 1), '') AS INTEGER) AS t FROM sec),
numbered AS (SELECT text_row, place, position, CASE WHEN t > 0 THEN t ELSE 1 END AS number FROM told WHERE place = 1 UNION ALL SELECT t.text_row, t.place, t.position, CASE WHEN t.t > 0 THEN t.t ELSE n.number + 1 END FROM numbered n JOIN told t ON t.text_row = n.text_row AND t.place = n.place + 1)"""
_BY_SECTION = "regexp_matches(full_text, '" + "|".join(latex.SECTION_NUMBERING) + "')"
_NAME = r"regexp_extract(body, '^\\begin\{([a-z]+)\}', 1)"


@query(rf"""WITH RECURSIVE {_PLACES}, {_STATEMENTS}, {_NUMBERED_SECTIONS}, every AS (SELECT *, {_NAME} AS env, row_number() OVER (PARTITION BY text_row, {_NAME} ORDER BY start) AS counter FROM st),
plain AS (SELECT st.*, full_text, {_LABELLED} AS label, CASE WHEN {_BY_SECTION} THEN (SELECT max_by(n.number, n.position) FROM numbered n WHERE n.text_row = st.text_row AND n.position < st.start) END AS section FROM every st JOIN latex_text USING (text_row) WHERE NOT regexp_matches({_BODY}, '^\[([^\]]+)\]')),
n AS (SELECT *, coalesce(CASE WHEN label IS NOT NULL AND contains(lower({_NEAR}), '\ref{{' || lower(label) || '}}') THEN nullif(regexp_extract(substr({_NEAR}, strpos(lower({_NEAR}), '\ref{{' || lower(label) || '}}') + length(label) + 6), '^[\s\n]*([0-9.]+)', 1), '') END, {_TOLD}, nullif(regexp_extract(label, '([0-9]+(?:\.[0-9]+)?)', 1), ''), section || '.' || counter, CAST(counter AS VARCHAR)) AS number FROM plain)
SELECT text_row, start, label, number, CASE WHEN env = 'theorem' THEN 'Theorem' ELSE regexp_extract(full_text, '\\newtheorem\{{' || env || '\}}\{{([^}}]+)\}}', 1) END || ' ' || number AS display_label, md5({_CONTENT}) AS content FROM n""")
def theorems_plain(spark, d):
    """Statements without a number of their own, with the number told nearby or counted, and what they are called."""
    c = F.col("full_text")
    each = _texts(spark, d).select("text_row", "full_text", latex.statements(c).alias("all"), F.when(latex.numbered_by_section(c), latex.sections(c)).alias("sections"))
    s = each.select("text_row", "full_text", "sections", F.explode(F.arrays_zip(F.col("all").alias("s"), latex.counters(F.col("all")).alias("counter"))).alias("x")).select("text_row", "full_text", "sections", "x.*").where("s.number is null")
    number = latex.plain_number(c, F.col("s"), F.col("counter"), F.col("sections"))
    return s.select("text_row", F.col("s.start").alias("start"), F.col("s.label").alias("label"), number.alias("number"), latex.display_name(c, F.col("s.env")).alias("shown"), F.md5("s.content").alias("content")).withColumn("display_label", F.concat("shown", F.lit(" "), "number")).drop("shown")


@query(f"WITH {_STATEMENTS} SELECT text_row, start, CAST(start + length(body) AS INTEGER) AS stop FROM st")
def match_spans(spark, d):
    return _statements(spark, d).select("text_row", "start", F.col("end").alias("stop"))


@query(f"WITH {_STATEMENTS} SELECT text_row, start, md5(trim(regexp_replace(left(full_text, start), '{WS}+', ' ', 'g'))) AS context FROM st JOIN latex_text USING (text_row)")
def prefix_context(spark, d):
    """Everything before a statement, white space collapsed; cut from the text only here."""
    return _statements(spark, d).select("text_row", "start", F.md5(latex.prefix_context(F.col("full_text"), F.col("start"))).alias("context"))


@query("SELECT text_row, array_to_string(" + " || ".join(f"regexp_extract_all(full_text, '{p}')" for p in latex.COMMANDS) + ", chr(10)) AS commands FROM latex_text WHERE full_text IS NOT NULL")
def custom_commands(spark, d):
    return _texts(spark, d).select("text_row", latex.commands(F.col("full_text")).alias("commands"))


@query(r"SELECT text_row, array_to_string(regexp_extract_all(full_text, '\\input\{([^}]+)\}', 1) || regexp_extract_all(full_text, '\\include\{([^}]+)\}', 1), ',') AS names FROM latex_text WHERE full_text IS NOT NULL")
def includes(spark, d):
    return _texts(spark, d).select("text_row", F.array_join(latex.includes(F.col("full_text")), ",").alias("names"))


_REPLY = "CASE WHEN qa_id % 2 = 0 THEN '\\section*{Final Answer} ' || coalesce(answer, '') || ' \\section{Notes}' ELSE coalesce(answer, '') END"
_FINALS = ", ".join(f"nullif({trim_sql(f'''regexp_extract(reply, '{p}', 1)''')}, '')" for p in text.FINAL_ANSWER)


@query(f"WITH {QA}, r AS (SELECT qa_id, {_REPLY} AS reply FROM qa) SELECT qa_id, coalesce({_FINALS}, reply) AS answer FROM r")
def final_answer(spark, d):
    """The final answer of a reply: its section, else all of it."""
    a = F.coalesce("answer", F.lit(""))
    reply = F.when(F.col("qa_id") % 2 == 0, F.concat(F.lit("\\section*{Final Answer} "), a, F.lit(" \\section{Notes}"))).otherwise(a)
    return base.qa(spark, d).select("qa_id", reply.alias("reply")).select("qa_id", text.final_answer(F.col("reply")).alias("answer"))


_TICK = "chr(96) || chr(96) || chr(96)"


@query(f"""WITH c AS (SELECT doc_id, text, contains(text, {_TICK} || 'python') AS own FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5({trim_sql("CASE WHEN own THEN (CASE WHEN regexp_matches(text, '(?s)```python\\n(.*?)```') THEN regexp_extract(text, '(?s)```python\\n(.*?)```', 1) ELSE text END) WHEN regexp_matches(text, '(?s)```\\n(.*?)```') THEN regexp_extract(text, '(?s)```\\n(.*?)```', 1) ELSE text END")}) AS code FROM c""")
def extract_code(spark, d):
    """The first fenced block of a text, else the text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(text.code_block(F.col("text"))).alias("code"))


@query("SELECT event_id, props AS block FROM events")
def extract_json_block(spark, d):
    """JSON read back out of a fenced reply."""
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("```\nThat is all."))
    return table(spark, d, "events").select("event_id", text.json_block(reply).alias("block"))


@query("SELECT doc_id, nullif(regexp_extract('def ' || lower(source) || '(x):', 'def\\s+(\\w+)\\s*\\(', 1), '') AS name FROM documents")
def func_name(spark, d):
    code = F.concat(F.lit("def "), F.lower("source"), F.lit("(x):"))
    return table(spark, d, "documents").select("doc_id", text.function_name(code).alias("name"))


_CAN = f"{trim_sql('split_part(' + trim_sql('''coalesce(generated_answer, '')''') + ', chr(10), 1)')}"


@query(f"WITH {RESULTS} SELECT result_id, {_CAN} AS a1, {trim_sql('''coalesce(model, '')''')} AS a2, 'NO_ANSWER' AS a3 FROM results")
def parse_blanks(spark, d):
    """Answers read out of a reply with markers in any case and order, one missing."""
    reply = F.concat(F.lit("BLANK2: "), F.coalesce("model", F.lit("")), F.lit("\nBlank1:  "), F.coalesce("generated_answer", F.lit("")))
    a = text.blanks(reply, 3)
    return base.results(spark, d).select("result_id", a[0].alias("a1"), a[1].alias("a2"), a[2].alias("a3"))


_PAIRS = f"{RESULTS}, pairs AS (SELECT result_id, coalesce(ground_truth, '') AS r, coalesce(generated_answer, '') AS h FROM results), lists AS (SELECT *, {tokens_sql('r')} AS rt, {tokens_sql('h')} AS ht, {rouge_tokens_sql('r')} AS rr, {rouge_tokens_sql('h')} AS hh FROM pairs)"
_EM, _F1, _BLEU, _LCS = f"{norm_sql('r')} = {norm_sql('h')}", f1_sql("r", "h"), bleu_sql("rt", "ht"), lcs_sql("rr", "hh")
_ROUGE = f"CASE WHEN {_LCS} = 0 THEN 0.0 ELSE 2.0 * ({_LCS}) / (len(rr) + len(hh)) END"


def _pairs(spark, d):
    return base.results(spark, d).select("result_id", F.coalesce("ground_truth", F.lit("")).alias("r"), F.coalesce("generated_answer", F.lit("")).alias("h"))


@query(f"WITH {_PAIRS} SELECT result_id, {_EM} AS em FROM pairs")
def exact_match(spark, d):
    return _pairs(spark, d).select("result_id", metrics.exact_match(F.col("r"), F.col("h")).alias("em"))


@query(f"WITH {_PAIRS} SELECT result_id, round({_F1}, 4) AS f1 FROM pairs")
def token_f1(spark, d):
    return _pairs(spark, d).select("result_id", F.round(metrics.token_f1(F.col("r"), F.col("h")), 4).alias("f1"))


@query(f"WITH {_PAIRS} SELECT result_id, round({_ROUGE}, 4) AS rouge FROM lists")
def rouge_l_nostem(spark, d):
    return _pairs(spark, d).select("result_id", F.round(metrics.rouge_l_plain(F.col("r"), F.col("h")), 4).alias("rouge"))


@query()
def rouge_l(spark, d):
    """ROUGE-L over Porter stems; Arrow batches."""
    return _pairs(spark, d).select("result_id", F.round(metrics.rouge_l("r", "h"), 4).alias("rouge"))


@query(f"WITH {_PAIRS} SELECT result_id, round({_BLEU}, 4) AS bleu FROM lists")
def bleu(spark, d):
    return _pairs(spark, d).select("result_id", F.round(metrics.bleu(F.col("r"), F.col("h")), 4).alias("bleu"))


@query(f"WITH {_PAIRS}, m AS (SELECT result_id, {_EM} AS em, {_ROUGE} AS rouge, {_BLEU} AS bleu FROM lists) SELECT result_id, em OR (rouge >= 0.8 AND bleu >= 0.5) AS correct FROM m")
def binary_correct(spark, d):
    return _pairs(spark, d).select("result_id", metrics.binary_correct(metrics.exact_match(F.col("r"), F.col("h")), metrics.rouge_l_plain(F.col("r"), F.col("h")), metrics.bleu(F.col("r"), F.col("h"))).alias("correct"))


@query(f"WITH {_PAIRS} SELECT result_id, {_EM} AS em, round({_F1}, 4) AS f1, round({_ROUGE}, 4) AS rouge, round({_BLEU}, 4) AS bleu FROM lists")
def blank_metrics(spark, d):
    r, h = F.col("r"), F.col("h")
    m = F.struct(metrics.exact_match(r, h).alias("em"), F.round(metrics.token_f1(r, h), 4).alias("f1"), F.round(metrics.rouge_l_plain(r, h), 4).alias("rouge"), F.round(metrics.bleu(r, h), 4).alias("bleu"))
    return _pairs(spark, d).select("result_id", m.alias("m")).select("result_id", "m.*")


@query(f"WITH {_PAIRS} SELECT result_id, {trim_sql('h')} = r AS same FROM pairs")
def compare_output(spark, d):
    """An output, trimmed, against the expected text as it stands."""
    return _pairs(spark, d).select("result_id", values.same_output(F.col("h"), F.col("r")).alias("same"))


@query("SELECT doc_id, coalesce(CAST(try_strptime(left(year_month || '-15', 10), '%Y-%m-%d') AS DATE), DATE '1900-01-01') AS day FROM documents")
def parse_date(spark, d):
    return table(spark, d, "documents").select("doc_id", dates.parsed_date(F.concat("year_month", F.lit("-15"))).alias("day"))


@query("SELECT doc_id, coalesce(strftime(try_strptime(year_month || '-15', '%Y-%m-%d'), '%Y-%m'), '2023-12') AS month, CAST(date_trunc('month', coalesce(try_strptime(year_month || '-15', '%Y-%m-%d'), TIMESTAMP '2023-12-01')) AS DATE) AS start FROM documents")
def month_key(spark, d):
    key = dates.month_key(F.concat("year_month", F.lit("-15")))
    return table(spark, d, "documents").select("doc_id", key.alias("month")).withColumn("start", dates.month_start(F.col("month")))


@query("SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM events GROUP BY 1, 2")
def month_start(spark, d):
    key = F.date_format("ts", "yyyy-MM")
    return table(spark, d, "events").groupBy("event_type", dates.month_start(key).alias("month")).agg(F.count("*").alias("n"))


_CASES = "'[{\"input\": \"' || event_id || '\", \"output\": \"' || event_type || '\", \"testtype\": \"stdin\"}]'"


def _cases():
    return F.concat(F.lit('[{"input": "'), F.col("event_id").cast("string"), F.lit('", "output": "'), "event_type", F.lit('", "testtype": "stdin"}]'))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n, CASE WHEN event_type <> 'error' THEN event_type END AS output FROM events")
def parse_test_cases(spark, d):
    """Test cases in a JSON string; broken ones give none."""
    s = F.when(F.col("event_type") == "error", F.lit("[{broken")).otherwise(_cases())
    c = values.test_cases(s)
    return table(spark, d, "events").select("event_id", F.size(c).alias("n"), F.try_element_at(c, F.lit(1))["output"].alias("output"))


@query("SELECT event_id, least(event_id % 5, 2) AS public, CASE WHEN event_id % 5 > 2 THEN event_id % 5 - 2 ELSE 3 END AS private, CASE WHEN event_id % 5 > 2 THEN 'c' || (event_id % 5) ELSE 'own' END AS last FROM events")
def split_tests(spark, d):
    """No to four cases cut after two: the rest is private, and where there is none the three private ones stay as they were."""
    case = lambda given: F.struct(given.alias("input"), F.lit("x").alias("output"), F.lit("stdin").alias("testtype"))
    n = (F.col("event_id") % 5).cast("int")
    cases = F.slice(F.transform(F.array(*[F.lit(i) for i in range(1, 5)]), lambda i: case(F.concat(F.lit("c"), i.cast("string")))), F.lit(1), n)
    public, private = values.split_cases(cases, 2, F.array_repeat(case(F.lit("own")), 3))
    return table(spark, d, "events").select("event_id", F.size(public).alias("public"), F.size(private).alias("private"), F.try_element_at(private, F.lit(-1))["input"].alias("last"))


@query(f"WITH {QA} SELECT qa_id, answer AS answer1, category AS answer2, is_good_qa AS answer3 FROM qa")
def answers_array(spark, d):
    """Wide answers to an array and back."""
    a = values.answers_array(["answer", "category", "is_good_qa"])
    return base.qa(spark, d).select("qa_id", a.alias("answers")).select("qa_id", *[F.try_element_at("answers", F.lit(i)).alias(f"answer{i}") for i in (1, 2, 3)])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS complete FROM events")
def json_required_keys(spark, d):
    """Typed reading of replies that must have a key."""
    v = values.typed(F.col("props"), "k bigint")
    return table(spark, d, "events").select("event_id", v["k"].alias("k"), values.has_keys(F.col("props"), "k").alias("complete"))


QUERIES, SQL = query.queries, query.sql
