"""The monthly build and the evaluation of a tree as one plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import latex, text
from marlstone.operators import accuracy, rows, stages
from marlstone.plans import base
from marlstone.plans.base import MONTH_SQL, month_of_batch
from marlstone.plans.joins import _STATEMENTS
from marlstone.plans.registry import QA, RESULTS, THEOREMS, WS, Registry
from marlstone.session import materialise, table

query = Registry()


@dataclass(frozen=True)
class Job:
    """What to build: a month, and categories or sub-categories but not both. ``quota`` pairs per topic and month are enough."""

    year: int
    month: int
    categories: tuple[str, ...] = ()
    subcategories: tuple[str, ...] = ()
    quota: int = 30

    def __post_init__(self) -> None:
        if not 1 <= self.month <= 12:
            raise ValueError("the month must be 1 to 12")
        if self.categories and self.subcategories:
            raise ValueError("give categories or sub-categories, not both")
        if self.quota < 1:
            raise ValueError("the quota must be at least 1")

    def wants(self, c):
        if self.subcategories:
            return c.isin(*self.subcategories)
        return text.category_prefix(c).isin(*self.categories) if self.categories else F.lit(True)


@dataclass(frozen=True)
class Cloze:
    """Limits of generated cloze questions."""

    blanks: int
    min_words: int = 1
    max_words: int = 5

    def __post_init__(self) -> None:
        if not 1 <= self.blanks <= 20:
            raise ValueError("blanks must be 1 to 20")
        if not 1 <= self.min_words <= self.max_words:
            raise ValueError("word limits must be 1 or more, the least not above the most")


def build_month(job: Job, papers: DataFrame, texts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(paper_id, category, start, env, content): statements of a month's papers not yet processed, at most ``quota`` per category.

    Papers and texts count once by id; appendices are left out. Only the first steps of the
    build, over raw texts: ``build_pairs`` is the whole.
    """
    month = f"{job.year:04d}-{job.month:02d}"
    p = papers.where((month_of_batch(F.col("batch_no")) == month) & F.col("id").isNotNull() & job.wants(F.col("category")))
    p = rows.keep_first(p, ["id"], [F.col("paper_row")]).select("id", "category")
    if done is not None:
        p = rows.unprocessed(p, done, "id")
    t = rows.keep_first(texts.where("full_text is not null and id is not null").select("id", "text_row", "full_text"), ["id"], [F.col("text_row")])
    found = p.join(t, "id").select(F.col("id").alias("paper_id"), "category", F.explode(latex.statements(latex.without_appendix(F.col("full_text")))).alias("s"))
    flat = found.select("paper_id", "category", "s.start", "s.env", "s.content")
    return rows.keep_first(flat, ["category"], [F.col("paper_id"), F.col("start")], n=job.quota)


#: What the build asks a model.
ASK_UNIQUE = "Does this statement have a single, definite answer?\n{theorem}"
ASK_PAIR = "Write a question and its answer from this statement:\n{theorem}"
ASK_TRIVIAL = "Is this pair trivial?\nCONTEXT: {context}\nQUESTION: {question}\nANSWER: {answer}"
#: Fixed value: pairs with a longer context are not asked about and go, as in the reference (a million tokens of 4 characters).
MOST_CONTEXT = 4_000_003


def ask_unique():
    return text.prompt(ASK_UNIQUE, theorem=F.col("content"))


def ask_pair():
    return text.prompt(ASK_PAIR, theorem=F.col("content"))


def ask_trivial():
    return text.prompt(ASK_TRIVIAL, context=F.col("context"), question=F.col("question"), answer=F.col("answer"))


def month_statements(papers: DataFrame, texts: DataFrame, job: Job | None = None, done: DataFrame | None = None) -> DataFrame:
    """(paper_id, topic, month, text_row, k, start, content, context): statements of papers not yet processed, of all months without a job.

    A paper belongs to the month that first brought its id, a text counts once by id. Comments
    go before the appendix is cut, and positions are those in the text that is left. The topic is
    the main category where a job asks for main categories, else the category.
    """
    p = rows.keep_first(papers.where("id is not null and batch_no is not null"), ["id"], [F.col("batch_no"), F.col("paper_row")]).withColumn("month", month_of_batch(F.col("batch_no")))
    topic = F.col("category")
    if job is not None:
        p = p.where((F.col("month") == f"{job.year:04d}-{job.month:02d}") & job.wants(F.col("category")))
        topic = text.category_prefix(topic) if job.categories else topic
    if done is not None:
        p = rows.unprocessed(p, done, "id")
    t = rows.keep_first(texts.where("full_text is not null and id is not null").select("id", "text_row", "full_text"), ["id"], [F.col("text_row")])
    body = latex.without_appendix(latex.remove_comments(F.col("full_text")))
    found = p.select("id", topic.alias("topic"), "month").join(t, "id").withColumn("body", body)
    each = found.select("id", "topic", "month", "text_row", "body", F.posexplode(latex.statements(F.col("body"))).alias("k", "s"))
    return each.select(F.col("id").alias("paper_id"), "topic", "month", "text_row", (F.col("k") + 1).alias("k"), F.col("s.start").alias("start"), F.col("s.content").alias("content"), latex.prefix_context(F.col("body"), F.col("s.start")).alias("context"))


def finished_pairs(found: DataFrame, unique: DataFrame, written: DataFrame, trivial: DataFrame, quota: int = 30) -> DataFrame:
    """(month, topic, paper_id, start, content, context, question, answer): the pairs that the stages leave of statements, at most ``quota`` per topic and month.

    ``unique``, ``written`` and ``trivial`` are recorded responses (prompt_key, response) to the
    prompts of ``ask_unique``, ``ask_pair`` and ``ask_trivial``. A statement without a reply on
    uniqueness goes, as does one whose pair is missing, empty or not told to be good; a pair
    without a verdict on triviality stays. The quota counts what is left, by paper and position.
    """
    own = ["month", "topic", "paper_id", "start", "content", "context"]
    asked = stages.replies(found.select(*own), ask_unique(), unique, ["single_unique_answer"], "single_unique_answer string")
    definite = stages.keep_judged(asked, F.col("reply.single_unique_answer"), "false", keep_failed=False).select(*own)
    told = stages.replies(definite, ask_pair(), written, ["question", "answer", "is_good_qa"], "question string, answer string, is_good_qa string")
    good = told.where("ok and lower(reply.is_good_qa) = 'true' and reply.question <> '' and reply.answer <> ''").select(*own, "reply.question", "reply.answer")
    judged = stages.replies(good.where(F.length("context") <= MOST_CONTEXT), ask_trivial(), trivial, ["is_trivial"], "is_trivial string")
    left = stages.keep_judged(judged, F.col("reply.is_trivial"), "true", keep_failed=True).select(*own, "question", "answer")
    return rows.keep_first(left, ["topic", "month"], [F.col("paper_id"), F.col("start")], n=quota)


def build_pairs(papers: DataFrame, texts: DataFrame, unique: DataFrame, written: DataFrame, trivial: DataFrame, job: Job | None = None, done: DataFrame | None = None) -> DataFrame:
    """The monthly build: papers, texts, statements, uniqueness, pairs, triviality, quota; of one job, or of all months and categories."""
    return finished_pairs(month_statements(papers, texts, job, done), unique, written, trivial, job.quota if job else Job.quota)


_APP = "least(" + ", ".join(f"CASE WHEN regexp_matches(full_text, '{p}', 'i') THEN strpos(full_text, regexp_extract(full_text, '{p}', 0, 'i')) END" for p in latex.APPENDIX) + ")"


@query(f"""WITH {_STATEMENTS}, p AS (SELECT id, category FROM papers WHERE id IS NOT NULL AND batch_no = 8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY paper_row) = 1),
l AS (SELECT id, text_row, {_APP} AS appendix FROM latex_text WHERE full_text IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY text_row) = 1)
SELECT p.id AS paper_id, category, start FROM p JOIN l ON l.id = p.id JOIN st ON st.text_row = l.text_row WHERE appendix IS NULL OR start < appendix - 1 QUALIFY row_number() OVER (PARTITION BY category ORDER BY p.id, start) <= 30""")
def monthly_dataset(spark, d):
    """The raw statements of February 2024: the build's first steps only; ``monthly_pairs`` is the whole."""
    return build_month(Job(2024, 2), table(spark, d, "papers"), table(spark, d, "latex_text")).select("paper_id", "category", "start")


_CLEAN = r"regexp_replace(replace(regexp_replace(replace(full_text, '\%', chr(1)), '%[^\n]*(?:\n|\z)', chr(10), 'g'), chr(1), '\%'), '\n\s*\n+', chr(10) || chr(10), 'g')"
_CONTENT = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(st.body, '(?s)^\\begin\{[^}]*\}(.*)\\end\{[^}]*\}$', 1), '^\[[^\]]+\]', ''), '\\label\{(.*?)\}', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"""WITH {THEOREMS}, {QA}, p AS (SELECT id, category, {MONTH_SQL} AS month FROM papers WHERE id IS NOT NULL AND batch_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch_no, paper_row) = 1),
clean AS (SELECT id, text_row, {_CLEAN} AS full_text FROM latex_text WHERE full_text IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY text_row) = 1),
body AS (SELECT id, text_row, CASE WHEN {_APP} IS NULL THEN full_text ELSE left(full_text, {_APP} - 1) END AS full_text FROM clean), {_STATEMENTS.replace("FROM latex_text", "FROM body")},
s AS (SELECT p.id AS paper_id, category AS topic, month, st.start, 3 * (st.text_row - 1) + st.place AS number, {_CONTENT} AS content, trim(regexp_replace(left(full_text, st.start), '{WS}+', ' ', 'g')) AS context FROM p JOIN body ON body.id = p.id JOIN st ON st.text_row = body.text_row),
told AS (SELECT content, theorem FROM (SELECT content, min(number) AS number FROM s GROUP BY 1) JOIN th ON th.id = number WHERE unique_answer_explanation IS NOT NULL),
pair AS (SELECT theorem, question, answer, is_good_qa FROM qa WHERE theorem IS NOT NULL QUALIFY row_number() OVER (PARTITION BY theorem ORDER BY qa_id) = 1)
SELECT month, topic, paper_id, start, question, answer FROM s JOIN told USING (content) JOIN pair USING (theorem) WHERE lower(is_good_qa) = 'true' AND question <> '' AND answer <> '' AND NOT contains(question, answer) AND NOT contains(context, answer) QUALIFY row_number() OVER (PARTITION BY topic, month ORDER BY paper_id, start) <= 30""")
def monthly_pairs(spark, d):
    """The whole build over all months: pairs that passed every stage, at most 30 per category and month.

    The tables hold no replies about these texts' statements, so replies stand in: the k-th
    statement of text r gets those recorded for theorem ``3 * (r - 1) + k`` (equal statements the
    least), and a pair is told to be trivial where its answer stands in its question or context.
    """
    found = materialise(month_statements(table(spark, d, "papers"), table(spark, d, "latex_text")), "statements")
    number = found.groupBy("content").agg(F.min(3 * (F.col("text_row") - 1) + F.col("k")).alias("id"))
    told = number.join(base.theorems(spark, d).select("id", "theorem", "unique_answer_explanation"), "id")
    single = F.to_json(F.struct(F.lit("true").alias("single_unique_answer"), F.col("unique_answer_explanation").alias("explanation")))
    key = lambda prompt: F.sha2(prompt, 256).alias("prompt_key")
    unique = told.where("unique_answer_explanation is not null").select(key(ask_unique()), single.alias("response"))
    first = base.qa(spark, d).where("theorem is not null").groupBy("theorem").agg(F.min_by(F.struct("question", "answer", "is_good_qa"), "qa_id").alias("pair"))
    pairs = told.join(first, "theorem").select("content", "pair.*")
    written = pairs.select(key(ask_pair()), F.to_json(F.struct("question", "answer", "is_good_qa")).alias("response"))
    inside = F.contains("question", "answer") | F.contains("context", "answer")
    trivial = found.join(pairs, "content").select(key(ask_trivial()), F.to_json(F.struct(inside.cast("string").alias("is_trivial"))).alias("response"))
    return finished_pairs(found, unique, written, trivial).select("month", "topic", "paper_id", "start", "question", "answer")


@query(f"WITH {RESULTS} SELECT q.batch_no, r.model, count(*) AS total, count(*) FILTER (WHERE r.is_correct) AS correct_count, round(count(*) FILTER (WHERE r.is_correct) / count(*), 6) AS accuracy FROM results r JOIN (SELECT qa_id, min(batch_no) AS batch_no FROM qa_pairs GROUP BY 1) q ON q.qa_id = r.question_id GROUP BY 1, 2")
def evaluate_tree(spark, d):
    """Each model's accuracy on each month's questions."""
    q = table(spark, d, "qa_pairs").groupBy(F.col("qa_id").alias("question_id")).agg(F.min("batch_no").alias("batch_no"))
    return accuracy.accuracy(base.results(spark, d).join(q, "question_id"), ["batch_no", "model"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {_STATEMENTS} SELECT {MONTH_SQL} AS month, count(DISTINCT p.id) AS papers, count(st.start) AS statements FROM (SELECT * FROM papers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY paper_row) = 1) p
LEFT JOIN (SELECT * FROM latex_text WHERE full_text IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY text_row) = 1) l ON l.id = p.id LEFT JOIN st ON st.text_row = l.text_row GROUP BY 1""")
def monthly_yield(spark, d):
    """Papers and statements by month."""
    p = rows.keep_first(table(spark, d, "papers").where("id is not null"), ["id"], [F.col("paper_row")])
    t = rows.keep_first(table(spark, d, "latex_text").where("full_text is not null and id is not null"), ["id"], [F.col("text_row")]).select("id", F.size(latex.statements(F.col("full_text"))).alias("n"))
    return p.join(t, "id", "left").groupBy(month_of_batch(F.col("batch_no")).alias("month")).agg(F.countDistinct("id").alias("papers"), F.coalesce(F.sum("n"), F.lit(0)).alias("statements"))


QUERIES, SQL = query.queries, query.sql
