"""Mixing sources to target weights by Poisson replication.

Method. A source that should make up a share of the total size is repeated at the mean
rate ``share * total / own size``, at most ``max_repeats``. Each document's number of
copies inverts a Poisson distribution at a value hashed from its id and the seed; the
distribution is cut off at ``max_repeats`` and its parameter is set such that the mean
of the cut-off distribution is the rate. A source whose rate reaches the cap has every
document ``max_repeats`` times and falls short. Documents are exploded by their
count and shuffled globally by a hash of id and copy.

Sizes are tokens of a public tokenizer's rank file, whose place is a parameter; Spark hands it to the workers.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words
from marlstone.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the public rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are counted in parts of about this many characters, cut where the pattern cuts.
PART = 1 << 20


def parts_of(text: str) -> Iterator[str]:
    """A text in parts whose tokens are those of the text: each ends between two pieces of the pattern, the former not white space."""
    if len(text) <= PART:
        yield text
        return
    import regex

    begin = 0
    for m in regex.finditer(PATTERN, text):
        at = m.start()
        if at - begin >= PART and not text[at - 1].isspace():
            yield text[begin:at]
            begin = at
    yield text[begin:]


@functools.lru_cache(4)
def _encoder(name: str):
    """The encoder of a rank file that Spark has handed to the workers; made once a worker."""
    import tiktoken
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(Path(name).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name).encode_ordinary
        for batch in words.bounded(batches, 1):
            sizes = [sum(len(encode(part)) for part in parts_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(sizes, pa.int64())], names=["doc_id", "source_key", "tokens"])

    return run


def source_key(c: Column) -> Column:
    """Sources are equal when letter case and outer white space are ignored."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def token_counts(docs: DataFrame, key: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(doc_id, source_key, tokens): a row per document with a key; null texts have no tokens."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), source_key(F.col(source)).alias("source_key"))
    return rows.mapInArrow(_counter(Path(tokenizer).name), "doc_id bigint, source_key string, tokens bigint")


def cut_poisson(rate: float, most: int) -> list[float]:
    """P(copies <= k) for k = 0 .. most - 1, of the Poisson distribution cut off at ``most`` with mean ``rate``. Worked out in logarithms, so no mean is too large."""
    if rate <= 0:
        return [1.0] * most
    if rate >= most:
        return [0.0] * most
    k = np.arange(most)
    factorials = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most)))))

    def cdf(mean: float) -> np.ndarray:
        return np.minimum(1.0, np.cumsum(np.exp(k * math.log(mean) - mean - factorials)))

    def cut_mean(mean: float) -> float:
        return float((1 - cdf(mean)).sum())  # the sum of P(copies > k)

    lo, hi = 0.0, max(1.0, 2 * rate)
    while cut_mean(hi) < rate and hi < 1e300:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and cut_mean(mid) < rate else (lo, mid)
    return cdf(hi).tolist()


class Mixture:
    """A mixture of ``docs`` by ``targets`` (source, target_share, max_repeats; small, collected).

    Documents of null or unlisted sources count towards the total size but aren't used.
    A source without documents falls short if its share is above 0. Null keys are left
    out; a key given more than once counts as often. Null and empty texts have no tokens.
    An empty table gives an empty mixture.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: int = 1):
        self.docs, self.key, self.text, self.source, self.seed = docs, key, text, source, seed
        self.spark = docs.sparkSession
        self.sizes = materialise(token_counts(docs, key, text, source, tokenizer), "token-counts")
        rows = targets.select("source", source_key(F.col("source")).alias("k"), "target_share", "max_repeats").collect()
        self.targets = {r["k"]: (r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in rows if r["k"] is not None}
        listed = F.when(F.col("source_key").isin(list(self.targets)), F.col("source_key"))
        own = {r["k"]: r["n"] for r in self.sizes.groupBy(listed.alias("k")).agg(F.sum("tokens").alias("n")).collect()}
        self.total = sum(own.values())
        self.own = {k: own.get(k, 0) for k in self.targets}
        self.rate = {k: (t * self.total / self.own[k] if self.own[k] else 0.0) for k, (_, t, _) in self.targets.items()}

    def short(self) -> list[str]:
        """Sources that cannot reach their share."""
        return [name for k, (name, t, m) in self.targets.items() if m * self.own[k] < t * self.total]

    def _copied(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, source_key, ...) of listed sources with ``source`` and ``copies``, without those that are not used."""
        plan = [(k, name, cut_poisson(min(self.rate[k], m), m)) for k, (name, _, m) in self.targets.items() if m > 0]
        table = self.spark.createDataFrame(plan, "source_key string, source string, below array<double>")
        # 53 bits of the hash make a uniform value in [0, 1)
        u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(self.seed)), 11) / F.lit(float(1 << 53))
        joined = rows.join(F.broadcast(table), "source_key").withColumn("u", u)  # a row per source
        return joined.withColumn("copies", F.size(F.filter("below", lambda x: x <= F.col("u")))).where("copies > 0").drop("u", "below", "source_key")

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, copies): the number of times each document is used, if at all."""
        return self._copied(self.sizes).select("doc_id", "source", "tokens", "copies")

    def report(self) -> DataFrame:
        """(source, own_tokens, target_share, max_repeats, mixed_tokens, actual_share, falls_short).

        A source falls short if the replication has used all of it ``max_repeats`` times and its
        mixed tokens still are below its share.
        """
        used = self.copies().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
        plan = self.spark.createDataFrame([(name, self.own[k], t, m, t * self.total) for k, (name, t, m) in self.targets.items()], "source string, own_tokens bigint, target_share double, max_repeats int, wanted double")
        mixed = F.coalesce("mixed", F.lit(0))
        short = (mixed >= F.col("max_repeats") * F.col("own_tokens")) & (mixed < F.col("wanted"))
        return plan.join(used, "source", "left").select("source", "own_tokens", "target_share", "max_repeats", mixed.alias("mixed_tokens"), F.round(mixed / F.lit(max(1, self.total)), 6).alias("actual_share"), short.alias("falls_short"))

    def rows(self) -> DataFrame:
        """(doc_id, copy_no, source, text), in a globally shuffled order.

        Copies depend on the id and the source alone, so the documents are read once more, with
        their texts, and shuffled once; nothing is joined. Rows that repeat an id are copied alike.
        """
        d = self.docs.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("bigint").alias("doc_id"), source_key(F.col(self.source)).alias("source_key"), F.col(self.text).alias("text"))
        copies = self._copied(d).withColumn("copy_no", F.explode(F.expr("sequence(1, copies)")))
        place = [F.xxhash64("doc_id", "copy_no", F.lit(self.seed + i)) for i in (1, 2)]
        return copies.repartition(place[0]).sortWithinPartitions(place[1]).select("doc_id", "copy_no", "source", "text")
