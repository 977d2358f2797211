"""The commands of ``python -m marlstone``: build, collate, count, evaluate and cloze, over Parquet tables on any file system."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text, tokens
from marlstone.operators import accuracy, rows, stages
from marlstone.plans import pipeline
from marlstone.session import exists, table, write_text
from marlstone.sources import files


@dataclass(frozen=True)
class Model:
    """A model that can be asked: by what interface, and up to when it was trained."""

    name: str
    api: str
    cutoff: date

    @classmethod
    def read(cls, told: str) -> list[Model]:
        """Models of a JSON object {name: {"api": ..., "cutoff": "YYYY-MM-DD"}}; each needs both."""
        out = []
        for name, m in json.loads(told).items():
            lacking = [k for k in ("api", "cutoff") if not m.get(k)]
            if lacking:
                raise ValueError(f"model {name} needs {' and '.join(lacking)}")
            out.append(cls(name, m["api"], date.fromisoformat(m["cutoff"])))
        return out


@contextmanager
def run_log(spark: SparkSession, path: str | None) -> Iterator[logging.Logger]:
    """A logger that also keeps its lines, written to ``path`` at the end, whatever happens."""
    log, kept = logging.getLogger("marlstone"), []

    class _Keep(logging.Handler):
        def emit(self, record: logging.LogRecord) -> None:
            kept.append(self.format(record))

    keep, shown = _Keep(), logging.StreamHandler()
    for h in (keep, shown):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    log.setLevel(logging.INFO)
    try:
        yield log
    except BaseException as e:
        log.error("ended by %s: %s", type(e).__name__, e)
        raise
    finally:
        for h in (keep, shown):
            log.removeHandler(h)
        if path:
            write_text(spark, path, "\n".join(kept) + "\n")


def build(spark: SparkSession, data: str, responses: str, out: str, job: pipeline.Job | None = None) -> DataFrame:
    """Finished pairs of a job, or of all months and categories, written to ``out`` by topic and month; papers already there are not worked through again."""
    done = spark.read.parquet(out).select(F.col("paper_id").alias("id")).distinct() if exists(spark, out) else None
    made = pipeline.build_pairs(table(spark, data, "papers"), table(spark, data, "latex_text"), *(table(spark, responses, n) for n in ("unique", "written", "trivial")), job, done)
    # what is there already is read while new rows are added beside it
    files.save(made, out, append=True, by=["topic", "month"])
    return spark.read.parquet(out)


def collate(spark: SparkSession, root: str, out: str) -> DataFrame:
    """The tables of a partition tree as one, each context once, in the place of the table at ``out``."""
    tree = spark.read.parquet(root)
    files.replace(rows.keep_first(tree, ["context"], [F.col("paper_id"), F.col("start")]), out)
    return spark.read.parquet(out)


def counter(spark: SparkSession, tokenizer: str) -> Column:
    """``words``, ``estimate`` or the path of a rank file, as a column function."""
    named = {"words": text.word_count, "estimate": text.token_estimate}
    return named.get(tokenizer) or tokens.bpe_counter(spark, tokenizer)


def count(spark: SparkSession, root: str, tokenizer: str = "words", limit: int = 200_000) -> DataFrame:
    """(month, topic, pairs, over_limit) with all totals, of a tree of pairs."""
    guarded = rows.token_guard(spark.read.parquet(root), ["question", "answer", "context"], counter(spark, tokenizer), limit)
    return guarded.rollup("month", "topic").agg(F.count("*").alias("pairs"), F.count_if("over_limit").alias("over_limit"))


def evaluate(spark: SparkSession, results: str, by: list[str]) -> DataFrame:
    """Accuracy of recorded results by the columns given; a question asked more than once of a model counts as its first answer."""
    return accuracy.accuracy(rows.keep_first(spark.read.parquet(results), ["result_id"], [F.col("evaluated_at").asc_nulls_last()]), by)


def cloze(spark: SparkSession, items: str, attempts: str, out: str, settings: pipeline.Cloze) -> DataFrame:
    """Cloze items of papers (link, title, date and a text) from recorded attempts (prompt_key, attempt, response), ERROR rows included, in the place of the table at ``out``."""
    p = spark.read.parquet(items)
    made = stages.cloze_items(p, text.prompt(ASK_CLOZE, title=F.col("title"), section=F.col("section")), spark.read.parquet(attempts), settings.blanks, settings.min_words, settings.max_words)
    files.replace(made, out)
    return spark.read.parquet(out)


#: Fixed value: what a cloze item is asked for with.
ASK_CLOZE = "Make a cloze question of this text.\nTITLE: {title}\nTEXT: {section}"
