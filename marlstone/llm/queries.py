"""The pN_ queries and the SQL that some of them can be checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import history, leaks, mixing, pairs_quality, sampling, splitting, subjects
from marlstone.llm.near_duplicates import Duplicates, Likeness, groups, near_duplicates, record_pairs
from marlstone.session import new_table_path, table

#: TESTDATA.md's likeness of questions and of paper texts.
QUESTIONS = Likeness("bag", 0.7, half=13, rows=3)
PAPERS = Likeness("shingles", 0.5, half=16, rows=2)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = {r["field"]: r for r in table(spark, d, "split_limits").collect()}  # a row per field
    out = None
    for name, key in (("latex_text.full_text", "text_row"), ("qa_pairs.context", "qa_id")):
        if name not in limits:
            continue
        source, column = name.split(".")
        part = splitting.split_texts(table(spark, d, source), key, column, limits[name]["max_chars"], limits[name]["overlap_chars"]).select(F.lit(name).alias("field"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    """The ordered pieces of every text."""
    return _pieces(spark, d)


def p1_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces, and whether these keep the limit and the overlap."""
    limits = table(spark, d, "split_limits").select("field", "max_chars", "overlap_chars")
    # a row per field
    pieces = _pieces(spark, d).select("field", "row_key", "piece_no", "start_char", "end_char", "piece").distinct().join(F.broadcast(limits), "field")
    before = F.lag("end_char").over(Window.partitionBy("field", "row_key").orderBy("piece_no"))  # the pieces of one text
    p = pieces.withColumn("before", before).withColumn("own", F.expr("substring(piece, cast(coalesce(before - start_char, 0) as int) + 1)"))
    fits = (F.length("piece") <= F.col("max_chars")) & (F.length("piece") == F.col("end_char") - F.col("start_char"))
    joined = F.coalesce(F.col("before") - F.col("start_char") == F.col("overlap_chars"), F.col("start_char") == 0)
    return p.groupBy("field", "row_key").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")).alias("digest"), F.bool_and(fits).alias("within_limit"), F.bool_and(joined).alias("overlap_exact"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that had to be split, and those with a stretch that has no boundary."""
    first = _pieces(spark, d).where("piece_no = 0 and over_limit")
    return first.select("field", "row_key", F.explode(F.when(F.col("no_boundary"), F.array(F.lit("over_limit"), F.lit("no_boundary"))).otherwise(F.array(F.lit("over_limit")))).alias("case_kind")).distinct()


def _sample(spark: SparkSession, d: str) -> sampling.ProportionalSample:
    return sampling.ProportionalSample(table(spark, d, "qa_pairs"), table(spark, d, "sample_targets"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample."""
    return _sample(spark, d).rows()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Every target category with what it has, what was wanted and what was drawn."""
    return _sample(spark, d).report()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories whose share or minimum can't be met."""
    return _sample(spark, d).missed()


def _near(spark: SparkSession, d: str) -> list[tuple[str, Duplicates]]:
    asked = [("qa_pairs", "qa_id", "question", QUESTIONS), ("latex_text", "text_row", "full_text", PAPERS)]
    with ThreadPoolExecutor(2) as pool:  # two searches that don't need each other
        jobs = [(f"{name}.{column}", pool.submit(near_duplicates, table(spark, d, name), key, column, like)) for name, key, column, like in asked]
    return [(field, job.result()) for field, job in jobs]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs of records, by field."""
    a, b = (record_pairs(x).select(F.lit(field).alias("field"), "key_a", "key_b") for field, x in _near(spark, d))
    return a.unionByName(b)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the group of near records that it is in, and its number of links."""
    a, b = (groups(x).select(F.lit(field).alias("field"), F.col("key").alias("record_key"), "group_id", "links") for field, x in _near(spark, d))
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their defect."""
    return pairs_quality.defective_pairs(table(spark, d, "qa_pairs"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """The batches in order, each against the indexes of those before."""
    papers = history.KnownIds(spark, new_table_path(spark, "paper-ids"), "id", "paper_row")
    for first, last, rows in history.runs_of(table(spark, d, "papers"), "batch_no", ["paper_row", "id"]):
        papers.extend(rows, first, last, "batch_no")
    path, questions = new_table_path(spark, "question-index"), None
    for first, last, rows in history.runs_of(table(spark, d, "qa_pairs"), "batch_no", ["qa_id", "question"], key="qa_id"):
        questions = questions or history.History(spark, path, QUESTIONS, "qa_id", "question", sample=rows)
        questions.extend(rows, first, last, "batch_no")
    known = [("papers", papers)] + ([("qa_pairs", questions)] if questions else [])
    out = [index.known().select(F.lit(name).alias("table_name"), "*") for name, index in known]
    return functools.reduce(DataFrame.unionByName, out)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that an earlier batch already brought."""
    return _known(spark, d).select("table_name", "record_key").distinct()


def p5_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Each batch's records that are not new, with the batch that first brought the like."""
    return _known(spark, d)


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document that holds a passage of an item, word for word or with substitutions, and where."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an item."""
    return p6_leaks(spark, d).where(F.col("longest_run") >= leaks.SPAN).select("doc_id", "item_id").distinct()


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents, shuffled."""
    return _mixture(spark, d).rows()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source reached."""
    return _mixture(spark, d).report()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their share."""
    return _mixture(spark, d).report().where("falls_short").select("source")


def p8_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of every document, with the sentences about them."""
    return subjects.subject_shares(table(spark, d, "documents"), table(spark, d, "subject_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus by subject."""
    return subjects.composition(table(spark, d, "documents"), p8_subjects(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_split": p1_split,
    "p1_reassembled": p1_reassembled,
    "p1_found": p1_found,
    "p2_sample": p2_sample,
    "p2_report": p2_report,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_by_batch": p5_by_batch,
    "p6_leaks": p6_leaks,
    "p6_found": p6_found,
    "p7_mixture": p7_mixture,
    "p7_report": p7_report,
    "p7_found": p7_found,
    "p8_subjects": p8_subjects,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

_LONG = """texts AS (SELECT DISTINCT 'latex_text.full_text' AS field, text_row AS row_key, full_text AS t FROM latex_text UNION SELECT DISTINCT 'qa_pairs.context', qa_id, context FROM qa_pairs),
long AS (SELECT field, row_key, t, max_chars FROM texts JOIN split_limits USING (field) WHERE length(t) > max_chars)"""
_SAMPLED = r"""recs AS (SELECT qa_id, min(lower(regexp_replace(category, '\s+', '', 'g'))) AS ckey FROM qa_pairs GROUP BY 1), n AS (SELECT CAST(ceil(count(*) / 4) AS BIGINT) AS size FROM recs),
goal AS (SELECT category, lower(regexp_replace(category, '\s+', '', 'g')) AS ckey, target_permille, min_rows FROM sample_targets),
ranked AS (SELECT qa_id, g.category, g.ckey, g.target_permille, g.min_rows, row_number() OVER (PARTITION BY g.ckey ORDER BY md5('1|' || qa_id), qa_id) AS rank FROM recs JOIN goal g USING (ckey)),
drawn AS (SELECT * FROM ranked ORDER BY rank > min_rows, (rank - 0.5) / target_permille, ckey LIMIT (SELECT size FROM n)),
report AS (SELECT g.category, (SELECT count(*) FROM ranked r WHERE r.ckey = g.ckey) AS available, CAST(ceil(g.target_permille * n.size / 1000) AS BIGINT) AS wanted, CAST(g.min_rows AS BIGINT) AS minimum, (SELECT count(*) FROM drawn r WHERE r.ckey = g.ckey) AS drawn FROM goal g, n)"""
_QUESTIONS = """q AS (SELECT DISTINCT qa_id, question FROM qa_pairs WHERE question IS NOT NULL), w AS (SELECT qa_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS x FROM q),
bag AS (SELECT qa_id, x, count(*) AS c FROM w GROUP BY 1, 2), size AS (SELECT qa_id, sum(c) AS n FROM bag GROUP BY 1),
both_ AS (SELECT a.qa_id AS key_a, b.qa_id AS key_b, sum(least(a.c, b.c)) AS s FROM bag a JOIN bag b ON a.x = b.x AND a.qa_id < b.qa_id GROUP BY 1, 2),
near AS (SELECT key_a, key_b FROM both_ JOIN size sa ON sa.qa_id = key_a JOIN size sb ON sb.qa_id = key_b WHERE s >= 0.7 * (sa.n + sb.n - s))"""
_TEXTS = """t AS (SELECT text_row, regexp_extract_all(lower(full_text), '[a-z0-9]+') AS w FROM latex_text WHERE full_text IS NOT NULL),
sh AS (SELECT DISTINCT text_row, array_to_string(w[i:i+4], ' ') AS x FROM t, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)), ts AS (SELECT text_row, count(*) AS n FROM sh GROUP BY 1),
tb AS (SELECT a.text_row AS key_a, b.text_row AS key_b, count(*) AS s FROM sh a JOIN sh b ON a.x = b.x AND a.text_row < b.text_row GROUP BY 1, 2),
tnear AS (SELECT key_a, key_b FROM tb JOIN ts sa ON sa.text_row = key_a JOIN ts sb ON sb.text_row = key_b WHERE s >= 0.5 * (sa.n + sb.n - s))"""
_PAPER = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(id, '\s+', '', 'g')), '([?#].*)?$', ''), '(\.pdf)?/*$', ''), '^[a-z]+://.*/', ''), '^(arxiv|doi|id)[:/]', ''), 'v[0-9]+$', '')"""
_KNOWN = f"""{_QUESTIONS}, first AS (SELECT qa_id, min(batch_no) AS b FROM qa_pairs WHERE batch_no IS NOT NULL GROUP BY 1),
links AS (SELECT key_a AS x, key_b AS y FROM near UNION ALL SELECT key_b, key_a FROM near), p AS (SELECT paper_row, batch_no, {_PAPER} AS k FROM papers WHERE id IS NOT NULL AND batch_no IS NOT NULL),
pf AS (SELECT k, min(batch_no) AS f FROM p WHERE k <> '' GROUP BY 1),
known AS (SELECT 'papers' AS table_name, paper_row AS record_key, batch_no, f AS first_batch FROM p JOIN pf USING (k) WHERE batch_no > f
UNION ALL SELECT 'qa_pairs', x, a.b, min(o.b) FROM links JOIN first a ON a.qa_id = x JOIN first o ON o.qa_id = y GROUP BY x, a.b HAVING a.b > min(o.b))"""
_RUN = """dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i)),
iw AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items), ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM iw, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i))"""



def _groups_sql(field: str, signature: str, near: str) -> str:
    """Groups of records: their sets as one sorted text each, near pairs between the least keys of equal sets, and what these reach."""
    f = field[0]
    return f"""{f}sig AS ({signature}), {f}rep AS (SELECT k, min(k) OVER (PARTITION BY s) AS rep FROM {f}sig),
{f}link AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM (SELECT key_a, key_b FROM {near} UNION ALL SELECT key_b, key_a FROM {near}) n JOIN {f}rep a ON a.k = n.key_a JOIN {f}rep b ON b.k = n.key_b WHERE a.rep <> b.rep),
{f}walk(x, y) AS (SELECT DISTINCT rep, rep FROM {f}rep UNION SELECT w.x, l.y FROM {f}walk w JOIN {f}link l ON l.x = w.y), {f}group AS (SELECT x, min(y) AS g FROM {f}walk GROUP BY 1), {f}degree AS (SELECT x, count(*) AS n FROM {f}link GROUP BY 1),
{f}rows AS (SELECT '{field}' AS field, k AS record_key, g AS group_id, coalesce(n, 0) AS links FROM {f}rep JOIN {f}group g ON g.x = rep LEFT JOIN {f}degree d ON d.x = rep)"""


_KEPT = "masks AS (SELECT unnest([" + ", ".join(str([i + 1 for i, c in enumerate(m) if c == "1"]) for m in leaks.MASKS) + f"]) AS kept, unnest(range({len(leaks.MASKS)})) AS k)"
#: Alignments by equal words at a mask's kept places, their equal words in islands with gaps of at most two words, the best island that a mask hit.
_LEAKS = f"""{_KEPT}, dl AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), il AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS w FROM eval_items WHERE item_text IS NOT NULL),
dh AS (SELECT doc_id, i, k, array_to_string(list_select(w[i:i+11], kept), ' ') AS h FROM dl, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i), masks), ih AS (SELECT item_id, i, k, array_to_string(list_select(w[i:i+11], kept), ' ') AS h FROM il, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS i), masks),
hit AS (SELECT DISTINCT doc_id, item_id, d.i - t.i AS shift, d.i - 1 AS place FROM dh d JOIN ih t USING (k, h)), al AS (SELECT DISTINCT doc_id, item_id, shift FROM hit),
dw AS (SELECT doc_id, i - 1 AS p, w[i] AS x FROM dl, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)), iw AS (SELECT item_id, i - 1 AS q, w[i] AS x FROM il, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
eq AS (SELECT a.*, p, CASE WHEN p - lag(p) OVER (PARTITION BY a.doc_id, a.item_id, shift ORDER BY p) <= 3 THEN 0 ELSE 1 END AS fresh FROM al a JOIN dw USING (doc_id) JOIN iw ON iw.item_id = a.item_id AND q = p - shift AND iw.x = dw.x),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS g FROM eq), run AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, shift, g ORDER BY p) AS r FROM isl),
runs AS (SELECT doc_id, item_id, shift, g, count(*) AS n, min(p) AS a, max(p) + 1 AS b FROM run GROUP BY doc_id, item_id, shift, g, r),
island AS (SELECT doc_id, item_id, shift, sum(n) AS agree, max(n) AS longest, min(a) AS a, max(b) AS b FROM runs GROUP BY doc_id, item_id, shift, g),
leak AS (SELECT * FROM island s WHERE (longest >= 12 OR (agree >= 12 AND agree >= 0.8 * (b - a))) AND EXISTS (SELECT 1 FROM hit h WHERE h.doc_id = s.doc_id AND h.item_id = s.item_id AND h.shift = s.shift AND h.place >= s.a AND h.place < s.b))"""
_BAGS = "SELECT qa_id AS k, array_to_string(list_sort(regexp_extract_all(lower(question), '[a-z0-9]+')), ' ') AS s FROM q WHERE regexp_matches(lower(question), '[a-z0-9]')"
_SETS = "SELECT text_row AS k, string_agg(x, '|' ORDER BY x) AS s FROM sh GROUP BY 1"

SQL: dict[str, str] = {
    "p1_reassembled": "SELECT DISTINCT 'latex_text.full_text' AS field, text_row AS row_key, md5(full_text) AS digest, true AS within_limit, true AS overlap_exact FROM latex_text WHERE full_text IS NOT NULL UNION SELECT 'qa_pairs.context', qa_id, md5(context), true, true FROM qa_pairs WHERE context IS NOT NULL",
    "p3_groups": f"WITH RECURSIVE {_QUESTIONS}, {_TEXTS}, {_groups_sql('qa_pairs.question', _BAGS, 'near')}, {_groups_sql('latex_text.full_text', _SETS, 'tnear')} SELECT * FROM qrows UNION ALL SELECT * FROM lrows",
    "p1_found": rf"""WITH {_LONG} SELECT field, row_key, 'over_limit' AS case_kind FROM long UNION ALL SELECT field, row_key, 'no_boundary' FROM long WHERE list_max(list_transform(string_split_regex(t, '[ \t\n\r]'), lambda x: length(x))) > max_chars""",
    "p2_found": f"WITH {_SAMPLED} SELECT category, 'share' AS missed FROM report WHERE available < wanted UNION ALL SELECT category, 'minimum' FROM report WHERE available < minimum",
    "p2_report": f"WITH {_SAMPLED} SELECT category, available, wanted, minimum, drawn, available < wanted AS missed_share, available < minimum AS missed_minimum FROM report",
    "p2_sample": f"WITH {_SAMPLED} SELECT qa_id AS record_key, category, rank, round((rank - 0.5) / target_permille, 6) AS priority FROM drawn",
    "p3_found": f"WITH {_QUESTIONS}, {_TEXTS} SELECT 'qa_pairs.question' AS field, key_a, key_b FROM near UNION ALL SELECT 'latex_text.full_text', key_a, key_b FROM tnear",
    "p5_found": f"WITH {_KNOWN} SELECT DISTINCT table_name, record_key FROM known",
    "p5_by_batch": f"WITH {_KNOWN} SELECT * FROM known",
    "p6_leaks": f"WITH {_LEAKS} SELECT doc_id, item_id, longest AS longest_run, CAST(agree AS BIGINT) AS agreeing_words, b - a AS overlap_words, a AS doc_word, a - shift AS item_word FROM leak QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY longest DESC, agree DESC, b - a DESC, a DESC, a - shift DESC) = 1",
    "p6_found": f"WITH {_RUN} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    # any size that grows with the tokens tells the same sources: characters stand in for tokens
    "p7_found": """WITH s AS (SELECT lower(trim(source, chr(9) || chr(10) || chr(13) || ' ')) AS k, sum(length(text)) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS n FROM s) SELECT m.source FROM mix_targets m LEFT JOIN s ON s.k = lower(trim(m.source)), t WHERE m.max_repeats * coalesce(s.n, 0) < m.target_share * t.n""",
}
