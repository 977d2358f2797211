"""Model stages that make and solve items, on recorded replies that reach every branch of their rules; guards and loads around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates, text, values
from marlstone.operators import rows, stages
from marlstone.plans import base
from marlstone.plans.registry import QA, RESULTS, THEOREMS, Registry, trim_sql, words_sql
from marlstone.session import materialise, new_table_path, table
from marlstone.sources import files

query = Registry()


def _json_sql(**fields: str) -> str:
    return "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ") AS VARCHAR)"


_Q = "title || ' [Blank1] then [blank2]'"
_ATTEMPT = f"""CASE (paper_row + attempt) % 7 WHEN 0 THEN {_json_sql(question=_Q, answer1="'word ' || paper_row", answer2="' two words '")} WHEN 1 THEN {_json_sql(question=_Q, answer1="'word'")}
WHEN 2 THEN {_json_sql(question="title || ' [blank1] alone'", answer1="'word'", answer2="'words'")} WHEN 3 THEN {_json_sql(question=_Q, answer1="'w'", answer2="'words'")} WHEN 4 THEN '{{"question": ' WHEN 5 THEN {_json_sql(question=_Q, answer1="'one two three four five six'", answer2="'words'")} END"""


@query(f"""WITH r AS (SELECT paper_row, attempt, {_ATTEMPT} AS reply FROM (SELECT paper_row, coalesce(title, 'N/A') AS title, unnest([1, 2, 3]) AS attempt FROM papers)),
v AS (SELECT paper_row, attempt, {", ".join(f"{trim_sql(f'''json_extract_string(reply, '$.{k}')''')} AS {k}" for k in ("question", "answer1", "answer2"))} FROM (SELECT * FROM r WHERE reply IS NOT NULL AND json_valid(reply))),
ok AS (SELECT * FROM v WHERE question <> '' AND contains(lower(question), '[blank1]') AND contains(lower(question), '[blank2]') AND length(answer1) > 1 AND length(answer2) > 1 AND len({words_sql("answer1")}) BETWEEN 1 AND 5 AND len({words_sql("answer2")}) BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY paper_row ORDER BY attempt) = 1)
SELECT paper_row, coalesce(question, 'ERROR') AS cloze_question, 2 AS num_blanks, CASE WHEN question IS NULL THEN 'All retries failed' END AS error, coalesce(answer1, 'ERROR') AS answer1, coalesce(answer2, 'ERROR') AS answer2 FROM papers LEFT JOIN ok USING (paper_row)""")
def cloze_generator_stage(spark, d):
    """Cloze items of papers: the first valid of three attempts, else an ERROR row. Attempts fail in every way there is."""
    p = table(spark, d, "papers").select("paper_row", F.coalesce("title", F.lit("N/A")).alias("title"))
    prompt = text.prompt("Make a cloze item of paper {row}: {title}", row=F.col("paper_row"), title=F.col("title"))
    q = F.concat("title", F.lit(" [Blank1] then [blank2]"))

    def reply(question=q, **answers):
        return F.to_json(F.struct(question.alias("question"), *[a.alias(k) for k, a in answers.items()]))

    one, two = F.lit("word"), F.lit("words")
    kinds = [
        reply(answer1=F.concat(F.lit("word "), F.col("paper_row").cast("string")), answer2=F.lit(" two words ")), reply(answer1=one), reply(F.concat("title", F.lit(" [blank1] alone")), answer1=one, answer2=two),
        reply(answer1=F.lit("w"), answer2=two), F.lit('{"question": '), reply(answer1=F.lit("one two three four five six"), answer2=two),
    ]
    kind = (F.col("paper_row") + F.col("attempt")) % 7
    response = F.coalesce(*[F.when(kind == i, k) for i, k in enumerate(kinds)])
    attempts = p.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3)))).select(F.sha2(prompt, 256).alias("prompt_key"), "attempt", response.alias("response"))
    return stages.cloze_items(p, prompt, attempts, 2).drop("title")


_FIRST = trim_sql("split_part(" + trim_sql("coalesce(generated_answer, '')") + ", chr(10), 1)")


@query(f"""WITH {RESULTS} SELECT result_id, CASE WHEN generated_answer = 'TIMEOUT' THEN 'TIMEOUT' WHEN generated_answer IS NULL OR generated_answer = 'ERROR' THEN 'ERROR' ELSE {_FIRST} END AS a1,
CASE WHEN generated_answer = 'TIMEOUT' THEN 'TIMEOUT' WHEN generated_answer IS NULL OR generated_answer = 'ERROR' THEN 'ERROR' ELSE 'NO_ANSWER' END AS a2 FROM results""")
def cloze_answerer_stage(spark, d):
    """Answers of models to items of two blanks; calls that failed or ran out of time have sentinels for both."""
    g = F.col("generated_answer")
    status = F.when(g.isin("TIMEOUT", "ERROR"), g)
    a = stages.cloze_answers(F.concat(F.lit("blank1: "), g), F.coalesce(status, F.lit("OK")), 2)
    return base.results(spark, d).select("result_id", a.alias("a")).select("result_id", F.col("a")[0].alias("a1"), F.col("a")[1].alias("a2"))


@query(f"""WITH {RESULTS}, registry AS (SELECT model, CASE WHEN month(cutoff_date) % 2 = 0 THEN 'responses' ELSE 'messages' END AS provider, upper(model) AS target FROM model_cutoffs WHERE cutoff_date IS NOT NULL)
SELECT result_id, provider, target, CASE WHEN provider IS NULL THEN 'Error: Unsupported model ' || coalesce(r.model, '') || '.' ELSE generated_answer END AS answer FROM results r LEFT JOIN registry g ON g.model = r.model""")
def solver_stage(spark, d):
    """Questions sent to the provider that a registry names for the model; models it lacks answer with an error, which is judged like any answer."""
    known = table(spark, d, "model_cutoffs").where("cutoff_date is not null")
    registry = known.select("model", F.when(F.month("cutoff_date") % 2 == 0, "responses").otherwise("messages").alias("provider"), F.upper("model").alias("target"))
    sent = stages.routed(base.results(spark, d).select("result_id", "model", "generated_answer"), "model", registry)
    return sent.select("result_id", "provider", "target", F.coalesce("refusal", "generated_answer").alias("answer"))


def _case_sql(given: str, wanted: str) -> str:
    return f"{{'input': {given}, 'output': {wanted}, 'testtype': 'stdin'}}"


_OLD = f"[{_case_sql("'abc ' || event_id", "'cab'")}, {_case_sql("'b'", "'bb'")}, {_case_sql("'c' || event_id", "'a'")}]"
_NEW = f"[{_case_sql("'X' || event_id", "'Y'")}, {_case_sql("'Z'", "'ZZ'")}, {_case_sql("'n' || event_id", "'m'")}]"
_STATEMENT = "CASE WHEN event_id % 2 = 0 THEN 'Sort ABC ' ELSE 'Sort ' END || event_type"
_PERTURBED = f"""CASE event_id % 5 WHEN 0 THEN chr(96) || chr(96) || chr(96) || 'json' || chr(10) || {_json_sql(problem_statement="'Sort XYZ ' || event_type", test_cases=_NEW)} || chr(96) || chr(96) || chr(96)
WHEN 1 THEN {_json_sql(problem_statement="'Order ' || event_type", test_cases=_NEW + "[1:1]")} WHEN 2 THEN 'Now sort XYZ' WHEN 3 THEN 'Sorry {{' END"""


@query(f"""WITH r AS (SELECT event_id, {_STATEMENT} AS statement, {_OLD} AS old, {_PERTURBED} AS reply FROM events), b AS (SELECT *, CASE WHEN contains(reply, chr(96)) THEN regexp_extract(reply, '(?s)json\\n(.*?)`', 1) ELSE reply END AS body FROM r),
p AS (SELECT *, coalesce(json_valid(body), false) AS readable FROM b),
c AS (SELECT *, CASE WHEN readable THEN from_json(json_extract(body, '$.test_cases'), '[{{"input": "VARCHAR", "output": "VARCHAR", "testtype": "VARCHAR"}}]') WHEN contains(lower(statement), 'abc') AND contains(reply, 'XYZ') THEN list_transform(old, lambda x: {{'input': translate(x.input, 'abc', 'XYZ'), 'output': translate(x.output, 'abc', 'XYZ'), 'testtype': x.testtype}}) ELSE [] END AS cases FROM p)
SELECT event_id, coalesce(CASE WHEN readable THEN json_extract_string(body, '$.problem_statement') END, body, statement) AS problem, CASE WHEN len(cases) > 0 THEN cases[1].input ELSE old[1].input END AS first_input, CASE WHEN len(cases) > 1 THEN len(cases) - 1 ELSE 2 END AS n_private,
CASE WHEN len(cases) > 1 THEN cases[-1].output ELSE old[3].output END AS last_output FROM c""")
def perturbation_stage(spark, d):
    """Rewritten problems with their test cases: fenced and bare JSON, too few cases, unreadable replies with and without the mapping, failed calls."""
    e, key, kind = table(spark, d, "events"), F.col("event_id").cast("string"), F.col("event_id") % 5

    def case(given, wanted):
        return F.struct(given.alias("input"), wanted.alias("output"), F.lit("stdin").alias("testtype"))

    old = [case(F.concat(F.lit("abc "), key), F.lit("cab")), case(F.lit("b"), F.lit("bb")), case(F.concat(F.lit("c"), key), F.lit("a"))]
    new = [case(F.concat(F.lit("X"), key), F.lit("Y")), case(F.lit("Z"), F.lit("ZZ")), case(F.concat(F.lit("n"), key), F.lit("m"))]
    whole = F.to_json(F.struct(F.concat(F.lit("Sort XYZ "), "event_type").alias("problem_statement"), F.array(*new).alias("test_cases")))
    few = F.to_json(F.struct(F.concat(F.lit("Order "), "event_type").alias("problem_statement"), F.array(new[0]).alias("test_cases")))
    tick = F.lit("```")
    reply = F.when(kind == 0, F.concat(tick, F.lit("json\n"), whole, tick)).when(kind == 1, few).when(kind == 2, "Now sort XYZ").when(kind == 3, "Sorry {")
    statement = F.concat(F.when(F.col("event_id") % 2 == 0, "Sort ABC ").otherwise("Sort "), "event_type")
    r = e.select("event_id", statement.alias("statement"), F.array(old[0]).alias("public"), F.array(*old[1:]).alias("private"), reply.alias("reply"))
    problem, public, private = stages.perturbed_problem(F.col("statement"), F.col("public"), F.col("private"), F.col("reply"))
    made = r.select("event_id", problem.alias("problem"), public.alias("public"), private.alias("private"))
    return made.select("event_id", "problem", F.try_element_at("public", F.lit(1))["input"].alias("first_input"), F.size("private").alias("n_private"), F.try_element_at("private", F.lit(-1))["output"].alias("last_output"))


_ASK, _SIGN, _NAME, _IN, _OUT, _END = stages.SOLVER_LINES
_CODE = f"CASE event_id % 3 WHEN 0 THEN 'Here:' || chr(10) || chr(96) || chr(96) || chr(96) || 'python' || chr(10) || 'print(' || event_id || ')' || chr(10) || chr(96) || chr(96) || chr(96) WHEN 1 THEN ' x = ' || event_id || ' ' END"


@query(f"""WITH r AS (SELECT *, {_CODE} AS reply FROM events)
SELECT event_id, md5(concat_ws(chr(10), '{_ASK}', event_type, CASE event_id % 4 WHEN 0 THEN '{_SIGN}' || chr(10) || 'def f(x):' WHEN 1 THEN '{_NAME}' || event_type END, CASE WHEN event_id % 7 > 0 THEN '{_IN}' || event_id END, CASE WHEN event_id % 7 > 0 THEN '{_OUT}' || event_type END, '{_END}')) AS prompt,
coalesce({trim_sql("CASE WHEN contains(reply, 'python') THEN regexp_extract(reply, '(?s)python\\n(.*?)`', 1) ELSE reply END")}, '') AS solution FROM r""")
def code_solver_stage(spark, d):
    """Prompts with a signature, a function's name or neither, with and without an example; solutions fenced, bare, and empty where the call failed."""
    key, kind = F.col("event_id").cast("string"), F.col("event_id")
    starter, entry = F.when(kind % 4 == 0, "def f(x):").otherwise(""), F.when(kind % 4 == 1, F.col("event_type")).otherwise("")
    one = F.array(F.struct(key.alias("input"), F.col("event_type").alias("output")))
    cases = F.when(kind % 7 > 0, one).otherwise(F.slice(one, 1, 0))
    reply = F.when(kind % 3 == 0, F.concat(F.lit("Here:\n```python\nprint("), key, F.lit(")\n```"))).when(kind % 3 == 1, F.concat(F.lit(" x = "), key, F.lit(" ")))
    return table(spark, d, "events").select("event_id", F.md5(stages.solver_prompt(F.col("event_type"), starter, entry, cases)).alias("prompt"), stages.solution(reply).alias("solution"))


@query(f"""WITH {QA}, a AS (SELECT qa_id, answer, (length(answer) - length(replace(answer, '$', ''))) % 2 = 0 AS compiles FROM qa WHERE answer IS NOT NULL)
SELECT qa_id, CASE WHEN NOT compiles AND length(answer) % 3 > 0 THEN {trim_sql("answer || '$ '")} ELSE answer END AS answer FROM a""")
def latex_repair_stage(spark, d):
    """Answers that do not compile with their recorded repair; a third has none and stays. An odd dollar sign stands for what the compiler said."""
    a = base.qa(spark, d).where("answer is not null").select("qa_id", "answer", (F.length(F.regexp_replace("answer", r"[^$]", "")) % 2 == 0).alias("compiles"))
    told = a.where("not compiles and length(answer) % 3 > 0").select(F.sha2(text.prompt(stages.ASK_REPAIR, answer=F.col("answer")), 256).alias("prompt_key"), F.concat("answer", F.lit("$ ")).alias("response"))
    return stages.repaired(a, "answer", "compiles", told).select("qa_id", "answer")


_TOLD = "CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'n/a' END"


@query(f"SELECT event_id, coalesce(strftime(try_strptime(left({_TOLD}, 10), '%Y-%m-%d'), '%Y-%m'), CASE WHEN event_id % 4 = 3 THEN strftime(ts, '%Y-%m') END, '2023-12') AS month FROM events")
def month_key_mixed(spark, d):
    """Months of dates told as text, with a time, as seconds since 1970, and unreadably."""
    kind = F.col("event_id") % 4
    told = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 2, "n/a")
    epoch = F.when(kind == 3, F.unix_timestamp(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", dates.month_key_of(told, epoch).alias("month"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN event_id % 8 = 1 WHEN 2 THEN true ELSE false END AS same FROM events")
def compare_result(spark, d):
    """Printed results of functions: lists are written again, texts lose their quotes, and errors and other text are compared as they are."""
    key, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    actual = F.when(kind == 0, F.concat(F.lit("["), key, F.lit(",2.0,true]"))).when(kind == 1, F.concat(F.lit('"'), key, F.lit('" '))).when(kind == 2, F.lit("ERROR: [1,2]")).otherwise(F.concat(F.lit("{x "), key))
    wanted = F.when(kind == 0, F.concat(F.lit("["), key, F.lit(", 2.0, True]"))).when(kind == 1, F.when(F.col("event_id") % 8 == 1, key).otherwise(F.concat(F.lit('"'), key, F.lit('"')))).when(kind == 2, F.lit("ERROR: [1,2]")).otherwise(F.concat(F.lit("{x  "), key))
    return table(spark, d, "events").select("event_id", values.same_result(actual, wanted).alias("same"))


_ESTIMATE = " + ".join(f"floor(length(coalesce({c}, '')) / 4)" for c in ("question", "answer", "context"))


@query(f"WITH {QA} SELECT qa_id, CAST({_ESTIMATE} AS BIGINT) AS tokens, {_ESTIMATE} > 300 AS over_limit FROM qa")
def token_limit_estimate(spark, d):
    """The token guard with another count and limit: a quarter of the characters, 300."""
    return rows.token_guard(base.qa(spark, d), ["question", "answer", "context"], text.token_estimate, 300).select("qa_id", F.col("tokens").cast("bigint").alias("tokens"), "over_limit")


_SAMPLE = "SELECT 'sample_' || strftime(m, '%Y-%m') || '_' || i AS question_id, strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '2023-05-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS m), (SELECT unnest([0, 1, 2]) AS i)"


@query(f"""WITH dated AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN '2023-0' || (item_id % 9 + 1) || '-10' WHEN 1 THEN 'soon' ELSE '' END AS question_date FROM eval_items)
SELECT 'missing' AS load, question_id, month FROM ({_SAMPLE}) UNION ALL SELECT 'there', 'q' || item_id, coalesce(left(nullif(question_date, 'soon'), 7), '2023-12') FROM dated WHERE question_date = 'soon' OR question_date BETWEEN '2023-05-01' AND '2024-02-29'""")
def problems_or_sample(spark, d):
    """Problems of a range of dates (unreadable ones stay, those without go), or the generated sample where none can be loaded."""
    path = new_table_path(spark, "problems")
    kind = F.col("item_id") % 3
    told = F.when(kind == 0, F.concat(F.lit("2023-0"), (F.col("item_id") % 9 + 1).cast("string"), F.lit("-10"))).when(kind == 1, "soon").otherwise("")
    table(spark, d, "eval_items").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"), told.alias("question_date")).write.json(path)
    out = None
    for name, where in (("missing", path + "-none"), ("there", path)):
        part = files.load_problems(spark, where).select(F.lit(name).alias("load"), "question_id", dates.month_key(F.col("question_date")).alias("month"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT unnest(['papers', 'empty', 'none', 'half']) AS name, unnest([true, false, false, false]) AS whole, unnest([true, true, false, true]) AS some_of_it, unnest([CAST((SELECT count(*) FROM papers) AS BIGINT), 0, 0, NULL]) AS n")
def dataset_validity(spark, d):
    """Whether written tables are there: finished with data, finished without, not at all, and unfinished."""
    papers, root = table(spark, d, "papers").select("paper_row"), new_table_path(spark, "datasets")
    papers.write.parquet(f"{root}/papers")
    spark.range(0).write.parquet(f"{root}/empty")
    papers.write.parquet(f"{root}/half")
    files.delete(spark, f"{root}/half/_SUCCESS")
    told = [(n, files.is_dataset(spark, f"{root}/{n}"), files.is_dataset(spark, f"{root}/{n}", every=False), None if n == "half" else files.count_or_zero(spark, f"{root}/{n}")) for n in ("papers", "empty", "none", "half")]
    return spark.createDataFrame(told, "name string, whole boolean, some_of_it boolean, n bigint")


@query("SELECT paper_row, id, citations FROM papers")
def arrow_dataset(spark, d):
    """A table saved as Arrow files, read back by a declared schema."""
    saved = materialise(files.to_arrow(table(spark, d, "papers").select("paper_row", "id", "citations")), "arrow-files")
    return files.from_arrow(saved, "data", "paper_row bigint, id string, citations int")


@query("SELECT paper_row, 'new' AS state FROM papers WHERE paper_row % 2 = 0")
def atomic_replace(spark, d):
    """A table that is replaced as a whole: readers see the old rows or the new ones."""
    path = new_table_path(spark, "replaced")
    p = table(spark, d, "papers").select("paper_row")
    for part, state in ((p, "old"), (p.where("paper_row % 2 = 0"), "new")):
        files.replace(part.withColumn("state", F.lit(state)), path)
    return spark.read.parquet(path)


_FILES = """f AS (SELECT text_row AS n, text_row % 20 AS paper, CASE WHEN text_row % 3 = 0 THEN 'sub/' ELSE '' END || 'f' || text_row || '.tex' AS path FROM latex_text),
refs AS (SELECT n, paper, path, unnest([{'p': 0, 'ref': 'f' || (n + 20)}, {'p': 1, 'ref': 'sub/f' || (n + 40) || '.tex'}, {'p': 2, 'ref': 'nowhere'}]) AS r FROM f),
named AS (SELECT *, CASE WHEN ends_with(r.ref, '.tex') THEN r.ref ELSE r.ref || '.tex' END AS ref FROM refs), cut AS (SELECT *, regexp_extract(path, '^(.*/)?') || ref AS beside, regexp_replace(ref, '^.*/', '') AS last FROM named)"""


@query(f"WITH {_FILES} SELECT c.paper, c.path AS source, coalesce(e.path, (SELECT min(o.path) FROM f o WHERE o.paper = c.paper AND regexp_replace(o.path, '^.*/', '') = c.last)) AS target, c.r.p AS position FROM cut c LEFT JOIN f e ON e.paper = c.paper AND e.path = c.beside WHERE target IS NOT NULL")
def include_edges(spark, d):
    """References read from files' texts, found beside the file or by their last part anywhere in the paper; what names no file goes."""
    n = F.col("text_row")
    path = F.concat(F.when(n % 3 == 0, "sub/").otherwise(""), F.lit("f"), n.cast("string"), F.lit(".tex"))
    content = F.concat(F.lit("Text \\input{f"), (n + 20).cast("string"), F.lit("} and \\input{sub/f"), (n + 40).cast("string"), F.lit(".tex}, \\include{nowhere}."))
    return files.include_edges(table(spark, d, "latex_text").select((n % 20).alias("paper"), path.alias("path"), content.alias("content")))


QUERIES, SQL = query.queries, query.sql
