"""JSON, arrays and outputs as columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text

CASES = "array<struct<input:string,output:string,testtype:string>>"


def test_cases(c: Column) -> Column:
    """Test cases of a JSON string; an empty array where it cannot be read."""
    return F.filter(F.coalesce(F.from_json(c, CASES), F.array().cast(CASES)), lambda x: x["input"].isNotNull() | x["output"].isNotNull())


def split_cases(cases: Column, k: int, private: Column) -> tuple[Column, Column]:
    """The first ``k`` cases, and the rest or, where there is none, the private cases as they were."""
    return F.slice(cases, 1, k), F.when(F.size(cases) > k, F.slice(cases, F.lit(k + 1), F.size(cases))).otherwise(private)


def answers_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c) for c in columns])


def has_keys(c: Column, *keys: str) -> Column:
    """Whether a reply is a JSON object with all keys and no null among them."""
    v = F.try_parse_json(c)
    out = v.isNotNull()
    for k in keys:
        out &= F.try_variant_get(v, f"$.{k}", "string").isNotNull()
    return F.coalesce(out, F.lit(False))


def typed(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


@F.pandas_udf(T.StringType())
def result_text(s: pd.Series) -> pd.Series:
    """A function's printed result as Python would show the value that its JSON stands for; other text, and errors, as they are. Arrow batches."""

    def one(t: str | None) -> str | None:
        if not t or t.startswith("ERROR"):
            return t
        try:
            return str(json.loads(t))
        except ValueError:
            return t

    return s.map(one)


def same_result(actual: Column, expected: Column) -> Column:
    """``same_output`` of a function's result: JSON is written again before it is compared."""
    return result_text(text.trimmed(actual)) == expected


def same_output(actual: Column, expected: Column) -> Column:
    """The actual output is trimmed, the expected one is not."""
    return text.trimmed(actual) == expected
