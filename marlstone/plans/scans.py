"""Sources, partitions and sinks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates, text
from marlstone.operators import accuracy, rows
from marlstone.plans import base
from marlstone.plans.base import MONTH_SQL, TOPICS_SQL, month_of_batch
from marlstone.plans.registry import QA, RESULTS, Registry
from marlstone.session import materialise, new_table_path, table
from marlstone.sources import files

query = Registry()

_WINDOW = "submitted_at BETWEEN TIMESTAMP '2024-02-01' AND TIMESTAMP '2024-03-02'"


@query(f"SELECT paper_row, id, CAST(submitted_at AS DATE) AS day FROM papers WHERE {_WINDOW}")
def scan_window(spark, d):
    """Papers submitted in a window of 30 days; the range reaches the scan."""
    return table(spark, d, "papers").where(dates.in_window(F.col("submitted_at"), "2024-02-01")).select("paper_row", "id", F.to_date("submitted_at").alias("day"))


@query(f"SELECT count(*) AS n FROM papers WHERE {_WINDOW}")
def count_window(spark, d):
    return table(spark, d, "papers").where(dates.in_window(F.col("submitted_at"), "2024-02-01")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT paper_id AS id, max(paper_citations) AS c FROM theorems WHERE paper_id IS NOT NULL GROUP BY 1), b AS (SELECT paper_id AS id, max(paper_citations) AS c FROM qa_pairs WHERE paper_id IS NOT NULL GROUP BY 1)
SELECT paper_row, coalesce(a.c, b.c, 0) AS citations, CASE WHEN a.c IS NOT NULL THEN 'primary' WHEN b.c IS NOT NULL THEN 'secondary' ELSE 'none' END AS origin FROM papers p LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def citation_fallback(spark, d):
    """Citations from the primary source, else the secondary, else 0."""
    def counts(name, c):
        return table(spark, d, name).where("paper_id is not null").groupBy(F.col("paper_id").alias("id")).agg(F.max("paper_citations").alias(c))

    joined = table(spark, d, "papers").join(counts("theorems", "a"), "id", "left").join(counts("qa_pairs", "b"), "id", "left")
    origin = F.when(F.col("a").isNotNull(), "primary").when(F.col("b").isNotNull(), "secondary").otherwise("none")
    return joined.select("paper_row", F.coalesce("a", "b", F.lit(0)).alias("citations"), origin.alias("origin"))


_PATH = f"concat_ws('/', 'output', CASE WHEN parent IS NOT NULL AND parent <> category THEN parent END, category, left({MONTH_SQL}, 4), right({MONTH_SQL}, 2), 'papers')"


def _paths(spark, d):
    p = table(spark, d, "papers").where("category is not null and batch_no is not null")
    month = month_of_batch(F.col("batch_no"))
    joined = p.join(rows.dimension(base.topics(spark).withColumnRenamed("topic", "category")), "category", "left")
    return joined.select("paper_row", files.partition_path("output", F.col("parent"), F.col("category"), F.substring(month, 1, 4).cast("int"), F.substring(month, 6, 2).cast("int"), "papers").alias("path"))


@query(f"WITH {TOPICS_SQL} SELECT DISTINCT {_PATH} AS path FROM papers p LEFT JOIN topics t ON t.topic = p.category WHERE category IS NOT NULL AND batch_no IS NOT NULL")
def partition_path(spark, d):
    """The folders that the papers belong to."""
    return _paths(spark, d).select("path").distinct()


@query(f"""WITH {TOPICS_SQL}, paths AS (SELECT paper_row, string_split({_PATH}, '/') AS w FROM papers p LEFT JOIN topics t ON t.topic = p.category WHERE category IS NOT NULL AND batch_no IS NOT NULL)
SELECT paper_row, w[-4] AS topic, w[-3] AS year, w[-2] AS month FROM paths""")
def path_metadata(spark, d):
    """Topic, year and month read from a folder's path."""
    return files.path_metadata(_paths(spark, d), "path").select("paper_row", "topic", "year", "month")


@query(f"WITH {TOPICS_SQL} SELECT coalesce(parent, split_part(category, '.', 1)) AS main, category AS topic, {MONTH_SQL} AS month, count(*) AS n FROM papers p LEFT JOIN topics t ON t.topic = p.category WHERE category IS NOT NULL GROUP BY 1, 2, 3")
def list_partitions(spark, d):
    """The partitions present and their rows: written as a partitioned table, found again by partition discovery."""
    p = table(spark, d, "papers").where("category is not null")
    looked = rows.with_lookup(p.withColumnRenamed("category", "topic"), base.topics(spark).withColumnRenamed("parent", "main"), "topic", "main", text.category_prefix(F.col("topic")))
    path = new_table_path(spark, "partitions")
    looked.withColumn("month", month_of_batch(F.col("batch_no"))).select("main", "topic", "month", "paper_row").repartition("main", "topic", "month").write.partitionBy("main", "topic", "month").parquet(path)
    return spark.read.schema("paper_row bigint, main string, topic string, month string").parquet(path).groupBy("main", "topic", "month").agg(F.count("*").alias("n"))


@query("SELECT category, count(*) AS n FROM papers GROUP BY 1")
def partition_counts(spark, d):
    return table(spark, d, "papers").groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT item_id, item_kind, length(item_text) AS chars FROM eval_items")
def json_scan(spark, d):
    """Written as JSON and read back with a declared schema."""
    path = new_table_path(spark, "items-json")
    table(spark, d, "eval_items").write.json(path)
    return files.read_json(spark, path, "item_id bigint, item_kind string, item_text string", array_per_file=False).select("item_id", "item_kind", F.length("item_text").alias("chars"))


@query("""SELECT 'sample_' || strftime(m, '%Y-%m') || '_' || i AS question_id, strftime(m, '%Y-%m-%d') AS question_date, CASE i WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty
FROM range(DATE '2023-05-01', DATE '2024-03-01', INTERVAL 1 MONTH) AS r(m), range(3) AS s(i)""")
def sample_problems(spark, d):
    """The stand-in benchmark: ten months with three problems each."""
    return files.sample_problems(spark).select("question_id", "question_date", "difficulty")


@query("SELECT strftime(m, '%Y-%m') AS month, count(p.paper_row) AS n FROM range(DATE '2023-07-01', DATE '2025-01-01', INTERVAL 1 MONTH) AS r(m) LEFT JOIN papers p ON date_trunc('month', p.submitted_at) = r.m GROUP BY 1")
def month_spine(spark, d):
    """Papers by month of submission, months without any included."""
    spine = spark.range(1).select(F.explode(dates.months_between("2023-07-01", "2024-12-01")).alias("m"))
    by = table(spark, d, "papers").groupBy(F.trunc(F.to_date("submitted_at"), "month").alias("m")).agg(F.count("*").alias("n"))
    return spine.join(by, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


_MEMBER = "concat(id, CASE WHEN batch = 0 THEN '/main.tex' WHEN batch = 1 THEN '/notes.txt' ELSE '/figure.eps' END)"
_MEMBERS = f"members AS (SELECT text_row, {_MEMBER} AS path, coalesce(full_text, '') AS content FROM (SELECT *, text_row % 3 AS batch FROM latex_text) WHERE id IS NOT NULL)"


def _members(spark, d):
    """Stand-in archives: every text is a member whose name depends on its row."""
    kind = F.when(F.col("text_row") % 3 == 0, "/main.tex").when(F.col("text_row") % 3 == 1, "/notes.txt").otherwise("/figure.eps")
    return table(spark, d, "latex_text").where("id is not null").select("text_row", F.concat("id", kind).alias("path"), F.coalesce("full_text", F.lit("")).alias("content"))


@query(f"""WITH {_MEMBERS} SELECT text_row, path FROM members WHERE path LIKE '%.tex' OR (regexp_matches(path, '\\.(txt|text|latex)$|/[^./]+$') AND (contains(left(content, 1000), '\\documentclass') OR contains(left(content, 1000), '\\begin{{document}}')))""")
def tex_members(spark, d):
    """Members that hold LaTeX, by name or by their first characters."""
    return files.tex_members(_members(spark, d)).select("text_row", "path")


@query(f"""WITH {_MEMBERS} SELECT split_part(path, '/', 1) AS id, min(text_row) AS text_row FROM (SELECT *, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY
CASE WHEN path LIKE '%/main.tex' THEN 0 WHEN contains(content, '\\documentclass') OR contains(content, '\\begin{{document}}') THEN 1 ELSE 2 END, length(content) DESC, path, text_row) AS k FROM members) WHERE k = 1 GROUP BY 1""")
def main_file(spark, d):
    """The main file of each paper: by name, by document marker, by size."""
    m = _members(spark, d).withColumn("id", F.split_part("path", F.lit("/"), F.lit(1)))
    return files.main_files(m, "id", "text_row").select("id", "text_row")


@query(f"WITH {_MEMBERS} SELECT id, max(n) AS chars FROM (SELECT split_part(path, '/', 1) AS id, length(content) AS n FROM members) GROUP BY 1")
def argmax_file(spark, d):
    """The size of each paper's largest member."""
    m = _members(spark, d)
    return m.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("id")).agg(F.max_by(F.length("content"), F.length("content")).alias("chars"))


@query(f"""WITH {RESULTS}, g AS (SELECT model, strftime(evaluated_at, '%Y-%m') AS month, count(*) AS total_problems, count(*) FILTER (WHERE is_correct) AS correct_problems FROM results WHERE evaluated_at IS NOT NULL GROUP BY 1, 2)
SELECT model, CAST(month || '-01' AS DATE) AS month, round(100.0 * correct_problems / total_problems, 4) AS accuracy FROM g""")
def plot_series(spark, d):
    """Rows ready to plot: a line per model over months."""
    r = base.results(spark, d).where("evaluated_at is not null").withColumn("month", F.date_format("evaluated_at", "yyyy-MM"))
    return accuracy.monthly(r, "model", "month", "is_correct").select("model", dates.month_start(F.col("month")).alias("month"), "accuracy")


@query(f"WITH {RESULTS} SELECT result_id, model, generated_answer FROM results WHERE is_correct = false")
def failed_cases(spark, d):
    return base.results(spark, d).where(~F.col("is_correct")).select("result_id", "model", "generated_answer")


@query(f"WITH {QA} SELECT paper_id, count(*) AS n, max(length(context)) AS longest FROM qa GROUP BY 1")
def append_overwrite(spark, d):
    """Two halves written one after the other, the second appended, and read as one table."""
    path = new_table_path(spark, "append")
    q = base.qa(spark, d).select("paper_id", "batch_no", "context")
    files.save(q.where("batch_no <= 9"), path)
    files.save(q.where("batch_no > 9 or batch_no is null"), path, append=True)
    return spark.read.schema(q.schema).parquet(path).groupBy("paper_id").agg(F.count("*").alias("n"), F.max(F.length("context")).alias("longest"))


@query("SELECT text_row || '/main.tex' AS member, md5(full_text) AS digest FROM latex_text WHERE full_text IS NOT NULL")
def archive_members(spark, d):
    """Texts packed into archives and unpacked again."""
    t = table(spark, d, "latex_text").where("full_text is not null")
    packed = materialise(files.pack(t.select(F.concat(F.col("text_row").cast("string"), F.lit("/main.tex")).alias("member"), F.col("full_text").alias("content"))), "archives")
    return files.archive_members(packed).select("member", F.md5("content").alias("digest"))


QUERIES, SQL = query.queries, query.sql

