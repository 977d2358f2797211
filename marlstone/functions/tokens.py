"""Counting tokens with a public rank file; Arrow batches."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the splitting pattern of the public rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def _encoder(name: str):
    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(Path(name).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_counter(spark: SparkSession, rank_file: str) -> Callable[[Column], Column]:
    """A column function that counts a text's tokens; Spark hands the rank file to the workers, which load it once."""
    spark.sparkContext.addFile(rank_file)
    name = Path(rank_file).name

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        encode = _encoder(name).encode_ordinary
        return s.map(lambda t: len(encode(t or "")))

    return count
