"""Collecting queries with the SQL that checks them, and the SQL's shared parts."""

from __future__ import annotations

from collections.abc import Callable

#: White space of any kind, as a class of the SQL engine's patterns.
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.sql[name or f.__name__] = sql
            return f

        return add


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm_sql(x: str) -> str:
    return f"lower({trim_sql(x)})"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


#: Rows delivered twice count once.
RESULTS = "results AS (SELECT * FROM eval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY evaluated_at NULLS LAST) = 1)"
QA = "qa AS (SELECT * FROM qa_pairs QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY ingested_at NULLS LAST) = 1)"
THEOREMS = "th AS (SELECT * FROM theorems QUALIFY row_number() OVER (PARTITION BY id ORDER BY paper_id NULLS LAST) = 1)"
