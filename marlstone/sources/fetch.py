"""Fetching stage: urls to bytes with retries, kept out of queries. The client is a parameter; nothing here opens a connection."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def get_with_backoff(get: Callable[[str], bytes], url: str, tries: int = 5, first_wait: float = 3.0) -> bytes:
    """The content, or nothing after ``tries`` failures; the wait doubles after each."""
    for attempt in range(tries):
        try:
            return get(url)
        except OSError:
            if attempt + 1 < tries:
                time.sleep(first_wait * 2**attempt)
    return b""


def fetch(df: DataFrame, url: str, get: Callable[[str], bytes], *, tries: int = 5, first_wait: float = 3.0, courtesy: float = 5.0) -> DataFrame:
    """(url, content) of distinct urls, one after the other within a task, with a pause between them. Write the result before using it twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for u in f["url"]:
                got.append(get_with_backoff(get, u, tries, first_wait))
                time.sleep(courtesy)
            yield pd.DataFrame({"url": f["url"], "content": got})

    return df.select(df[url].alias("url")).where("url is not null").distinct().mapInPandas(run, "url string, content binary")
