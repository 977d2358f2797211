"""Stages around external models: prompts, recorded responses, validation and failure rules.

A stage renders a prompt per row, looks its response up by the prompt's hash and
validates it. Live calls are one more source of responses (``call``), never part of a
query; nothing here reaches a network.
"""

from __future__ import annotations

import shutil
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text, values
from marlstone.operators.rows import dimension, with_responses

#: Outcomes of a test.
OUTCOMES = ("PASS", "FAIL", "TIMEOUT", "ERROR", "SKIP")


def replies(df: DataFrame, prompt: Column, responses: DataFrame, required: list[str], schema: str) -> DataFrame:
    """``df`` with ``reply`` (typed by ``schema``) and ``ok``: a response that has all required keys."""
    joined = with_responses(df, prompt, responses)
    return joined.withColumn("ok", values.has_keys(F.col("response"), *required)).withColumn("reply", F.when(F.col("ok"), values.typed(F.col("response"), schema)))


def keep_judged(df: DataFrame, verdict: Column, drop_on: str, keep_failed: bool) -> DataFrame:
    """Rows whose verdict is not ``drop_on``; rows without any reply stay or go by ``keep_failed``. A reply without a verdict keeps its row."""
    failed = ~F.col("ok")
    return df.where(F.when(failed, F.lit(keep_failed)).otherwise(F.coalesce(F.lower(verdict.cast("string")) != drop_on, F.lit(True))))


def first_valid(df: DataFrame, prompt: Column, attempts: DataFrame, schema: str, valid: Column, tries: int = 3) -> DataFrame:
    """``df`` with ``reply``: that of the first of ``tries`` attempts that is valid, null where none is.

    ``attempts`` has (prompt_key, attempt, response); ``valid`` sees the columns response and reply.
    """
    read = attempts.where(F.col("attempt") <= tries).withColumn("reply", values.typed(F.col("response"), schema)).where(F.coalesce(valid, F.lit(False)))
    first = read.groupBy("prompt_key").agg(F.min_by("reply", "attempt").alias("reply"))
    return df.withColumn("prompt_key", F.sha2(prompt, 256)).join(first, "prompt_key", "left")


#: Fixed value: what an item without a valid reply becomes.
FAILED_ITEM = "ERROR"


def cloze_items(df: DataFrame, prompt: Column, attempts: DataFrame, blanks: int, least: int = 1, most: int = 5, tries: int = 3) -> DataFrame:
    """``df`` with cloze_question, num_blanks, error, answer1 to answerN: generated items, and ERROR rows where no attempt is valid."""
    keys = ["question", *[f"answer{i}" for i in range(1, blanks + 1)]]
    part = lambda k: text.trimmed(F.col(f"reply.{k}"))
    answers = F.array(*[part(k) for k in keys[1:]])
    valid = values.has_keys(F.col("response"), *keys) & text.cloze_is_valid(part("question"), answers, least, most)
    got = first_valid(df, prompt, attempts, ", ".join(f"{k} string" for k in keys), valid, tries)
    item = {"cloze_question" if k == "question" else k: F.coalesce(part(k), F.lit(FAILED_ITEM)) for k in keys}
    return got.withColumns({**item, "num_blanks": F.lit(blanks), "error": F.when(F.col("reply").isNull(), "All retries failed")}).drop("prompt_key", "reply")


def cloze_answers(response: Column, status: Column, blanks: int) -> Column:
    """A model's answers to a cloze item; those of a call that ran out of time or failed are all that outcome."""
    failed = F.when(status == "TIMEOUT", "TIMEOUT").when(response.isNull() | (status == "ERROR"), "ERROR")
    return F.coalesce(F.when(failed.isNotNull(), F.array_repeat(failed, blanks)), text.blanks(response, blanks))


def routed(df: DataFrame, model: str, registry: DataFrame) -> DataFrame:
    """``df`` with ``provider`` and ``target`` (what the provider calls the model) of a small registry (model, provider, target), and ``refusal`` for models it lacks."""
    one = dimension(registry.select(F.col("model").alias("_m"), "provider", "target").dropDuplicates(["_m"]))
    unknown = F.concat(F.lit("Error: Unsupported model "), F.coalesce(model, F.lit("")), F.lit("."))
    return df.join(one, F.col(model) == F.col("_m"), "left").withColumn("refusal", F.when(F.col("provider").isNull(), unknown)).drop("_m")


def perturbed_problem(statement: Column, public: Column, private: Column, response: Column) -> tuple[Column, Column, Column]:
    """(statement, public cases, private cases) of a rewritten problem.

    A reply is JSON with problem_statement and test_cases, fenced or not. One that cannot be read is
    the statement as it stands, with cases made by the character mapping where it was applied. Without
    a reply all stays. The cases are cut again after as many as were public; with too few, private ones stay.
    """
    body = text.json_block(text.trimmed(response))
    read = F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT")
    mapped = F.transform(F.concat(public, private), lambda c: F.struct(text.perturbed(c["input"]).alias("input"), text.perturbed(c["output"]).alias("output"), c["testtype"].alias("testtype")))
    none = F.array().cast(values.CASES)
    told = F.coalesce(F.from_json(body, f"test_cases {values.CASES}")["test_cases"], none)
    by_hand = F.when(F.contains(F.lower(statement), F.lit("abc")) & F.contains(response, F.lit("XYZ")), mapped).otherwise(none)
    cases = F.when(response.isNull(), none).when(read, told).otherwise(by_hand)
    n = F.size(public)
    said = F.coalesce(F.when(read, F.try_variant_get(F.try_parse_json(body), "$.problem_statement", "string")), body)
    head, tail = values.split_cases(cases, n, private)
    return F.coalesce(said, statement), F.when(F.size(cases) > 0, head).otherwise(public), tail


#: The lines of a solver's prompt.
SOLVER_LINES = ("Solve this problem in Python:", "Start from this signature:", "Name the function: ", "Example input: ", "Example output: ", "Give the code alone.")


def solver_prompt(statement: Column, starter: Column, entry: Column, cases: Column) -> Column:
    """A code solver's prompt: the statement, the signature or else the function's name, and the first case where there is one."""
    ask, signature, name, given, wanted, end = (F.lit(x) for x in SOLVER_LINES)
    one = F.try_element_at(cases, F.lit(1))
    how = F.when(starter != "", F.concat_ws("\n", signature, starter)).when(entry != "", F.concat(name, entry))
    return F.concat_ws("\n", ask, statement, how, F.concat(given, one["input"]), F.concat(wanted, one["output"]), end)


def solution(response: Column) -> Column:
    """The code of a reply; empty where the call failed."""
    return F.coalesce(text.code_block(response), F.lit(""))


#: Fixed value: what a repair asks.
ASK_REPAIR = "Repair the LaTeX of this answer and change nothing else:\n{answer}"


def repaired(df: DataFrame, answer: str, compiles: str, responses: DataFrame) -> DataFrame:
    """``df`` with answers that do not compile replaced by their recorded repair, trimmed; those without one stay, as do unknown ones."""
    asked = with_responses(df, text.prompt(ASK_REPAIR, answer=F.col(answer)), responses)
    return asked.withColumn(answer, F.when(~F.col(compiles) & F.col("response").isNotNull(), text.trimmed(F.col("response"))).otherwise(F.col(answer))).drop("prompt_key", "response")


def call(df: DataFrame, prompt: Column, model: Callable[[list[str]], list[str | None]], tries: int = 3) -> DataFrame:
    """(prompt_key, response) from a live model, asked per Arrow batch for what has no answer yet. The caller stores it as responses."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: list[str | None] = [None] * len(f)
            for _ in range(tries):
                open_ = [i for i, g in enumerate(got) if g is None]
                if not open_:
                    break
                for i, answer in zip(open_, model([f["p"].iloc[i] for i in open_])):
                    got[i] = answer
            yield pd.DataFrame({"prompt_key": f["prompt_key"], "response": got})

    asked = df.select(prompt.alias("p")).distinct().select(F.sha2("p", 256).alias("prompt_key"), "p")
    return asked.mapInPandas(run, "prompt_key string, response string")


def in_parallel(ask: Callable[[str], str], at_once: int = 60) -> Callable[[list[str]], list[str | None]]:
    """A model for ``call`` that asks for one prompt at a time, ``at_once`` of them together per task; an error is no answer."""

    def one(p: str) -> str | None:
        try:
            return ask(p)
        except Exception:  # whatever a client raises, the stage's failure rule decides
            return None

    def model(prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(prompts)))) as pool:
            return list(pool.map(one, prompts))

    return model


#: Fixed value: the document that a fragment is tried in.
DOCUMENT = "\\documentclass{article}\n\\usepackage{amsmath,amssymb,amsthm}\n\\begin{document}\n%s\n\\end{document}\n"


def compiles(df: DataFrame, fragment: str, *, compiler: str = "pdflatex", timeout: float = 20.0) -> DataFrame:
    """``df`` with ``compiles``: whether a fragment compiles; null where it is null or the worker has no compiler. Shell escapes are off."""

    @F.udf("boolean")
    def run(text: str | None) -> bool | None:
        program = shutil.which(compiler)
        if text is None or program is None:
            return None
        with tempfile.TemporaryDirectory() as folder:
            (Path(folder) / "x.tex").write_text(DOCUMENT % text)
            try:
                return subprocess.run([program, "-no-shell-escape", "-interaction=nonstopmode", "-halt-on-error", "x.tex"], cwd=folder, capture_output=True, timeout=timeout).returncode == 0
            except subprocess.TimeoutExpired:
                return False

    return df.withColumn("compiles", run(F.col(fragment)))


def outcome(status: Column, correct: Column) -> Column:
    """A recorded run's outcome."""
    return F.when(status.isNull(), "SKIP").when(status.isin("TIMEOUT", "ERROR"), status).when(status == "NO_ANSWER", "SKIP").when(correct, "PASS").otherwise("FAIL")


def run_code(code: str, case_input: str, timeout: float = 5.0) -> tuple[str, str]:
    """(outcome, output) of a program on one standard input."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "solution.py"
        path.write_text(code)
        try:
            done = subprocess.run([sys.executable, "-I", str(path)], input=case_input, capture_output=True, text=True, timeout=timeout, cwd=folder)
        except subprocess.TimeoutExpired:
            return "TIMEOUT", ""
    return ("ERROR", done.stderr[-500:]) if done.returncode else ("RAN", done.stdout)


def execute(df: DataFrame, code: str, cases: str, *, allow_untrusted: bool = False, timeout: float = 5.0) -> DataFrame:
    """``df`` (code, and an array of cases with input and output) with ``results``: an outcome per case.

    Runs what models wrote, so it must be allowed explicitly; recorded results need no run.
    """
    if not allow_untrusted:
        raise PermissionError("running generated code must be allowed explicitly")

    @F.udf("array<string>")
    def run(program: str | None, tests) -> list[str]:
        out = []
        for t in tests or []:
            if not program or t["output"] is None:
                out.append("SKIP")
                continue
            status, said = run_code(program, t["input"] or "", timeout)
            out.append(status if status != "RAN" else "PASS" if said.strip() == t["output"] else "FAIL")
        return out

    return df.withColumn("results", run(F.col(code), F.col(cases)))
