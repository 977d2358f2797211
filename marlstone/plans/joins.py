"""Joins, de-duplication, windows, order and set operations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates, latex, text
from marlstone.operators import accuracy, rows
from marlstone.plans import base
from marlstone.plans.base import TOPICS_SQL
from marlstone.plans.registry import QA, RESULTS, THEOREMS, Registry
from marlstone.session import table
from marlstone.sources import files

query = Registry()


@query("SELECT paper_row, id FROM papers WHERE id IS NULL OR id NOT IN (SELECT id FROM latex_text WHERE id IS NOT NULL)")
def anti_processed(spark, d):
    """Papers without extracted text."""
    return rows.unprocessed(table(spark, d, "papers"), table(spark, d, "latex_text"), "id").select("paper_row", "id")


@query("SELECT paper_row, id FROM papers WHERE id IN (SELECT id FROM latex_text WHERE id IS NOT NULL)")
def semi_processed(spark, d):
    return rows.processed(table(spark, d, "papers"), table(spark, d, "latex_text"), "id").select("paper_row", "id")


@query(f"WITH {TOPICS_SQL} SELECT paper_row, coalesce(parent, split_part(category, '.', 1)) AS main FROM papers LEFT JOIN topics ON topic = category")
def topic_category(spark, d):
    """The main category: from the topic dimension, else the part before the first dot."""
    p = table(spark, d, "papers").withColumnRenamed("category", "topic")
    return rows.with_lookup(p, base.topics(spark).withColumnRenamed("parent", "main"), "topic", "main", text.category_prefix(F.col("topic"))).select("paper_row", "main")


@query(f"""WITH {RESULTS}, g AS (SELECT question_id, model, min(ground_truth) AS r, min(generated_answer) AS h FROM results GROUP BY 1, 2)
SELECT question_id, model, i AS place, string_split(coalesce(r, ''), ' ')[i] AS reference, string_split(coalesce(h, ''), ' ')[i] AS hypothesis
FROM g, LATERAL (SELECT unnest(range(1, greatest(len(string_split(coalesce(r, ''), ' ')), len(string_split(coalesce(h, ''), ' '))) + 1)) AS i)""")
def zip_blanks(spark, d):
    """References and hypotheses side by side by position, the shorter list filled with nulls."""
    g = base.results(spark, d).groupBy("question_id", "model").agg(F.min("ground_truth").alias("r"), F.min("generated_answer").alias("h"))
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), " ")
    pairs = g.select("question_id", "model", F.posexplode(F.arrays_zip(split("r").alias("reference"), split("h").alias("hypothesis"))).alias("i", "p"))
    return pairs.select("question_id", "model", (F.col("i") + 1).cast("bigint").alias("place"), "p.reference", "p.hypothesis")


_PROMPT = "'Judge: ' || coalesce(question, '')"


@query(f"""WITH {QA}, {RESULTS}, answers AS (SELECT sha256('Judge: ' || question) AS k, min(generated_answer) AS response FROM results WHERE question IS NOT NULL GROUP BY 1)
SELECT qa_id, response FROM qa LEFT JOIN answers ON k = sha256({_PROMPT})""")
def response_join(spark, d):
    """Pairs with the recorded response to their prompt."""
    r = base.results(spark, d).where("question is not null").select(F.sha2(F.concat(F.lit("Judge: "), "question"), 256).alias("prompt_key"), F.col("generated_answer").alias("response"))
    return rows.with_responses(base.qa(spark, d), text.prompt("Judge: {question}", question=F.col("question")), r).select("qa_id", "response")


_SECTIONS = latex.SECTION
_PLACES = f"""cut AS (SELECT text_row, string_split_regex(full_text, '{_SECTIONS}') AS parts, regexp_extract_all(full_text, '{_SECTIONS}') AS found, regexp_extract_all(full_text, '{_SECTIONS}', 1) AS titles FROM latex_text WHERE full_text IS NOT NULL),
sec AS (SELECT text_row, i AS place, titles[i] AS title, CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i-1], lambda p: length(p))), 0) AS INTEGER) AS position FROM cut, LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i))"""
_ENV = r"\\begin\{(?:theorem|thm)\}(?s:.*?)\\end\{(?:theorem|thm)\}"
_ENV_PLAIN = r"\\begin\{theorem\}(?s:.*?)\\end\{theorem\}"
#: The declared environments of the tables are ``theorem`` and ``thm``.
_BOTH = r"contains(full_text, '\newtheorem{thm}{Theorem}')"
_STATEMENTS = f"""cut2 AS (SELECT text_row, CASE WHEN {_BOTH} THEN string_split_regex(full_text, '{_ENV}') ELSE string_split_regex(full_text, '{_ENV_PLAIN}') END AS parts, CASE WHEN {_BOTH} THEN regexp_extract_all(full_text, '{_ENV}') ELSE regexp_extract_all(full_text, '{_ENV_PLAIN}') END AS found FROM latex_text WHERE full_text IS NOT NULL),
st AS (SELECT text_row, i AS place, found[i] AS body, CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i-1], lambda p: length(p))), 0) AS INTEGER) AS start FROM cut2, LATERAL (SELECT unnest(range(1, len(found) + 1)) AS i))"""


@query(f"""WITH {_PLACES}, {_STATEMENTS} SELECT st.text_row, st.start, (SELECT max_by(title, position) FROM sec WHERE sec.text_row = st.text_row AND sec.position < st.start) AS title FROM st""")
def asof_section(spark, d):
    """Each statement with the section that it stands in."""
    t = table(spark, d, "latex_text").where("full_text is not null")
    s = t.select("text_row", latex.sections(F.col("full_text")).alias("sections"), F.explode(latex.statements(F.col("full_text"))).alias("s"))
    return s.select("text_row", F.col("s.start").alias("start"), latex.section_at(F.col("sections"), F.col("s.start"))["title"].alias("title"))


@query("SELECT model, count(*) AS n, max(paper_row) AS last FROM papers CROSS JOIN model_cutoffs GROUP BY 1")
def model_cross(spark, d):
    """Every model with every paper, counted."""
    return rows.for_each_model(table(spark, d, "papers").select("paper_row"), table(spark, d, "model_cutoffs")).groupBy("model").agg(F.count("*").alias("n"), F.max("paper_row").alias("last"))


_PAPER_DATE = "coalesce(CAST(try_strptime('20' || left(paper_id, 2) || '-' || substr(paper_id, 3, 2) || '-01', '%Y-%m-%d') AS DATE), DATE '1900-01-01')"


@query(f"WITH {RESULTS} SELECT r.result_id, coalesce({_PAPER_DATE} < c.cutoff_date, false) AS before_cutoff FROM results r LEFT JOIN model_cutoffs c ON c.model = r.model")
def before_cutoff(spark, d):
    """Whether a result's paper is older than its model's cutoff."""
    return dated(spark, d).select("result_id", "before_cutoff")


def dated(spark, d):
    """Results with their paper's date and whether it is before the model's cutoff."""
    r = base.results(spark, d).withColumn("date", dates.parsed_date(F.concat(F.lit("20"), F.substring("paper_id", 1, 2), F.lit("-"), F.substring("paper_id", 3, 2), F.lit("-01"))))
    cut = rows.dimension(table(spark, d, "model_cutoffs").dropDuplicates(["model"]))
    return r.join(cut, "model", "left").withColumn("before_cutoff", accuracy.before_cutoff(F.col("date"), F.col("cutoff_date")))


@query(f"""WITH {RESULTS}, a AS (SELECT strftime(evaluated_at, '%Y-%m') AS month, model, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 4) AS acc FROM results WHERE evaluated_at IS NOT NULL GROUP BY 1, 2)
SELECT month, coalesce(max(CASE WHEN model = 'orin-mini' THEN acc END), 0) AS first, coalesce(max(CASE WHEN model = 'orin-large' THEN acc END), 0) AS second FROM a WHERE model IN ('orin-mini', 'orin-large') GROUP BY 1""")
def model_months(spark, d):
    """Two models by month, 0 where one has nothing: a full outer join."""
    r = base.results(spark, d).where("evaluated_at is not null").withColumn("month", F.date_format("evaluated_at", "yyyy-MM"))
    by = accuracy.monthly(r, "model", "month", "is_correct")
    one, two = (by.where(F.col("model") == m).select("month", F.col("accuracy").alias(c)) for m, c in (("orin-mini", "first"), ("orin-large", "second")))
    return one.join(two, "month", "full_outer").select("month", F.coalesce("first", F.lit(0.0)).alias("first"), F.coalesce("second", F.lit(0.0)).alias("second"))


# files 1 to n of a made-up source tree: each includes its two children in the order of a heap
_EDGES = "edges AS (SELECT text_row AS source, text_row * 2 AS target, 0 AS position FROM latex_text UNION ALL SELECT text_row, text_row * 2 + 1, 1 FROM latex_text)"


@query(f"""WITH RECURSIVE {_EDGES}, walk(path, way) AS (SELECT CAST(1 AS BIGINT), [0] UNION ALL SELECT e.target, list_append(way, e.position) FROM walk JOIN edges e ON e.source = walk.path WHERE e.target <= (SELECT max(text_row) FROM latex_text))
SELECT path, row_number() OVER (ORDER BY way) AS place FROM walk""")
def include_order(spark, d):
    """Depth-first order of files that include each other: a made-up tree; ``file_order`` reads the texts."""
    t = table(spark, d, "latex_text").select("text_row")
    last = t.agg(F.max("text_row").alias("last"))
    edges = t.select(F.col("text_row").alias("source"), F.posexplode(F.array(F.col("text_row") * 2, F.col("text_row") * 2 + 1)).alias("position", "target")).crossJoin(F.broadcast(last)).where("target <= last")  # one row
    roots = spark.createDataFrame([(1,)], "root bigint")
    return files.include_order(edges.select("source", "target", "position"), roots).select("path", F.col("place").cast("bigint").alias("place"))


# no text of the tables refers to another one, so every file but the main one is unreferenced; tests have the references
@query(r"""WITH m AS (SELECT split_part(id, 'v', 1) AS paper, text_row || '.tex' AS path, coalesce(full_text, '') AS content FROM latex_text WHERE id IS NOT NULL),
ranked AS (SELECT paper, path, row_number() OVER (PARTITION BY paper ORDER BY NOT (contains(content, '\documentclass') OR contains(content, '\begin{document}')), length(content) DESC, path) AS k FROM m)
SELECT paper, path, row_number() OVER (PARTITION BY paper ORDER BY k > 1, path) AS place FROM ranked""")
def file_order(spark, d):
    """The files of each paper from the main one along the references of the texts, then those not referenced; a paper's versions are its files."""
    t = table(spark, d, "latex_text").where("id is not null")
    members = t.select(F.split_part("id", F.lit("v"), F.lit(1)).alias("paper"), F.concat(F.col("text_row").cast("string"), F.lit(".tex")).alias("path"), F.coalesce("full_text", F.lit("")).alias("content"))
    return files.file_order(members).select("paper", "path", F.col("place").cast("bigint").alias("place"))


@query("SELECT l.text_row, coalesce(min(p.paper_row), min(q.paper_row)) AS paper_row FROM latex_text l LEFT JOIN papers p ON p.id = l.id LEFT JOIN papers q ON split_part(q.id, 'v', 1) = split_part(l.id, 'v', 1) GROUP BY 1")
def include_resolve(spark, d):
    """A reference resolved by its exact name, else by its base name; the least match counts."""
    p, t = table(spark, d, "papers"), table(spark, d, "latex_text").select("text_row", "id")
    exact = p.where("id is not null").groupBy("id").agg(F.min("paper_row").alias("exact"))
    stem = lambda c: F.split_part(c, F.lit("v"), F.lit(1))
    near = p.where("id is not null").groupBy(stem(F.col("id")).alias("stem")).agg(F.min("paper_row").alias("near"))
    joined = t.withColumn("stem", stem(F.col("id"))).join(exact, "id", "left").join(near, "stem", "left")
    return joined.groupBy("text_row").agg(F.coalesce(F.min("exact"), F.min("near")).alias("paper_row"))


@query("SELECT id, paper_row FROM papers QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_no, paper_row) = 1")
def dedupe_first_id(spark, d):
    return rows.keep_first(table(spark, d, "papers"), ["id"], [F.col("batch_no"), F.col("paper_row")]).select("id", "paper_row")


@query("SELECT paper_link, text_row FROM latex_text QUALIFY row_number() OVER (PARTITION BY paper_link ORDER BY text_row) = 1")
def dedupe_first_link(spark, d):
    return rows.keep_first(table(spark, d, "latex_text"), ["paper_link"], [F.col("text_row")]).select("paper_link", "text_row")


@query(f"WITH {THEOREMS} SELECT id FROM th QUALIFY row_number() OVER (PARTITION BY context ORDER BY id) = 1")
def dedupe_context(spark, d):
    """One statement per context text. The shuffle is keyed by a 128-bit digest, not by the text."""
    t = base.theorems(spark, d).select("id", F.md5("context").alias("digest"))
    return rows.keep_first(t, ["digest"], [F.col("id")]).select("id")


@query(f"WITH {_STATEMENTS} SELECT text_row, start + length(body) AS end_pos, min(start) AS start FROM st GROUP BY 1, 2")
def dedupe_spans(spark, d):
    """One statement per end position, numbered ones first; in order of start."""
    t = table(spark, d, "latex_text").where("full_text is not null")
    s = t.select("text_row", F.explode(latex.statements(F.col("full_text"))).alias("s")).select("text_row", "s.*")
    return rows.keep_first(s, ["text_row", "end"], [F.col("number").isNull(), F.col("start")]).select("text_row", F.col("end").alias("end_pos"), "start")


@query(f"""WITH {TOPICS_SQL}, asked(place, entry) AS (VALUES (1, 'physics'), (2, 'math.CO'), (3, 'gr-qc'), (4, 'cs.LG'), (5, 'math.CO')),
jobs AS (SELECT a.place, coalesce(t.topic, a.entry) AS topic FROM asked a LEFT JOIN topics t ON t.parent = a.entry AND t.topic <> t.parent), one AS (SELECT topic, min(place) AS place FROM jobs GROUP BY 1)
SELECT o.topic, count(p.paper_row) AS papers FROM one o LEFT JOIN papers p ON p.category = o.topic GROUP BY 1""")
def job_expand(spark, d):
    """A list of topics, parents replaced by their parts, each once, with their papers."""
    asked = spark.createDataFrame([("physics, math.CO,gr-qc ,, cs.LG,math.CO",)], "arg string").select(F.posexplode(text.listed(F.col("arg"))).alias("place", "entry"))
    dim = base.topics(spark).where("topic <> parent").withColumnRenamed("topic", "sub")
    jobs = asked.join(F.broadcast(dim), F.col("entry") == F.col("parent"), "left").select("place", F.coalesce("sub", "entry").alias("topic"))
    once = rows.keep_first(jobs, ["topic"], [F.col("place")])
    p = table(spark, d, "papers").groupBy(F.col("category").alias("topic")).agg(F.count("*").alias("n"))
    return once.join(p, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("papers"))


@query(f"WITH {_STATEMENTS} SELECT text_row, start, regexp_extract(body, '^\\\\begin\\{{([a-z]+)\\}}', 1) AS env, row_number() OVER (PARTITION BY text_row, regexp_extract(body, '^\\\\begin\\{{([a-z]+)\\}}', 1) ORDER BY start) AS n FROM st")
def env_counter(spark, d):
    """A running number per text and environment."""
    t = table(spark, d, "latex_text").where("full_text is not null")
    s = t.select("text_row", F.explode(latex.statements(F.col("full_text"))).alias("s")).select("text_row", "s.start", "s.env")
    return rows.numbered(s, ["text_row", "env"], [F.col("start")], "n")


@query(f"WITH {THEOREMS} SELECT id, row_number() OVER (PARTITION BY paper_id ORDER BY id) AS number FROM th")
def running_index(spark, d):
    """A number per statement that depends only on the paper and the order in it."""
    return rows.numbered_wide(base.theorems(spark, d).select("id", "paper_id"), ["paper_id"], ["id"], "number").select("id", "number")


@query("SELECT paper_row, id, batch_no FROM papers ORDER BY batch_no, paper_row LIMIT 50")
def top_n(spark, d):
    return table(spark, d, "papers").orderBy("batch_no", "paper_row").limit(50).select("paper_row", "id", "batch_no")


@query("SELECT paper_row FROM papers ORDER BY md5('42|' || paper_row), paper_row LIMIT 40")
def seeded_sample(spark, d):
    """Forty papers in an order that depends on the seed alone."""
    return rows.hash_sample(table(spark, d, "papers"), "paper_row", 40).select("paper_row")


@query(f"WITH {QA} SELECT qa_id, batch_no FROM qa QUALIFY row_number() OVER (PARTITION BY batch_no, category ORDER BY qa_id) <= 30")
def quota_per_partition(spark, d):
    """At most 30 pairs per month and category."""
    return rows.keep_first(base.qa(spark, d), ["batch_no", "category"], [F.col("qa_id")], n=30).select("qa_id", "batch_no")


@query("SELECT paper_row, CAST(floor((row_number() OVER (PARTITION BY batch_no ORDER BY paper_row) - 1) / 10) AS BIGINT) AS batch FROM papers")
def batch_assign(spark, d):
    return rows.batches(table(spark, d, "papers").select("paper_row", "batch_no"), ["batch_no"], ["paper_row"], 10).select("paper_row", F.col("batch").cast("bigint").alias("batch"))


@query("SELECT 'papers' AS origin, id FROM papers UNION ALL SELECT 'latex_text', id FROM latex_text")
def union_all_append(spark, d):
    old, new = (table(spark, d, n).select(F.lit(n).alias("origin"), "id") for n in ("papers", "latex_text"))
    return rows.append(old, new)


@query("SELECT id FROM papers UNION SELECT id FROM latex_text")
def union_ids(spark, d):
    return table(spark, d, "papers").select("id").union(table(spark, d, "latex_text").select("id")).distinct()


@query("SELECT paper_row AS n, id, 0 AS new FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY paper_row) = 1 UNION ALL SELECT min(text_row), id, 1 FROM latex_text WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM papers WHERE id IS NOT NULL) GROUP BY id")
def append_idempotent(spark, d):
    """Appending with keys: running it twice changes nothing."""
    old = table(spark, d, "papers").where("id is not null").groupBy("id").agg(F.min("paper_row").alias("n")).withColumn("new", F.lit(0))
    new = table(spark, d, "latex_text").where("id is not null").groupBy("id").agg(F.min("text_row").alias("n")).withColumn("new", F.lit(1))
    return rows.append(rows.append(old, new, ["id"]), new, ["id"]).select("n", "id", "new")


@query("SELECT id FROM papers INTERSECT SELECT paper_id FROM qa_pairs")
def intersect_ids(spark, d):
    return table(spark, d, "papers").select("id").intersect(table(spark, d, "qa_pairs").select(F.col("paper_id").alias("id")))


@query("SELECT id FROM papers EXCEPT SELECT paper_id FROM qa_pairs")
def except_ids(spark, d):
    return table(spark, d, "papers").select("id").subtract(table(spark, d, "qa_pairs").select(F.col("paper_id").alias("id")))


QUERIES, SQL = query.queries, query.sql
