"""Checking new batches against everything already accepted, by indexes that grow batch by batch.

``History`` is an inverted index of rare-token prefixes (see ``prefixes``), partitioned
by token: a batch probes the postings of its own prefix tokens, pairs are filtered by
size, place and bitmap, the elements of the candidates alone are fetched to verify the
overlap, and the postings of new texts are appended. ``KnownIds`` is the same for exact
ids. Both read only the parts of the index that hold a token or candidate of the batch
(see ``parted``); earlier batches are not worked through again.

Batches that are there together can be added as a run of batches (``extend``): its rows meet the
index once and each other once, with the answers that they have one by one. Runs that are as
large as what they meet (``runs_of``) read an index of n rows about log n times, however many batches there are.

A run takes effect when its manifest is written, after all its data. One that
failed half-way left nothing that counts, and can be added again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from marlstone.llm import prefixes, units
from marlstone.llm.near_duplicates import Likeness
from marlstone.llm.parted import FAN_IN, PART_ROWS, Parted, Segment, no_rows
from marlstone.session import delete, exists, materialise, names, new_table_path, read_text, scratch, write_text

KNOWN = "record_key bigint, batch_no int, first_batch int"

#: Rows of a unit that one task pairs at once; a row of a hot unit is copied for as many tasks as the unit has of these.
HOT = 100_000
#: Where the index has so many times a run's postings, those of other tokens are left out before they are sent around.
FEW = 4


def paper_key(column: str) -> Column:
    """The paper that an id names: without address, scheme prefix, version, case and white space. Null or blank ids name none."""
    c = F.lower(F.regexp_replace(F.col(column), r"(?U)\s+", ""))
    c = F.regexp_replace(c, r"([?#].*)?$", "")
    c = F.regexp_replace(c, r"(\.pdf)?/*$", "")
    c = F.regexp_replace(c, r"^[a-z]+://.*/", "")
    c = F.regexp_replace(c, r"^(arxiv|doi|id)[:/]", "")
    c = F.regexp_replace(c, r"v[0-9]+$", "")
    return F.nullif(c, F.lit(""))


class _Growing:
    """Tables of an index with a manifest per run of batches. Runs are added one at a time, in ascending order; the last one may be added again."""

    tables: dict[str, Parted]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """(record_key, first_batch): the batch's records that an accepted one is like, with the earliest batch of such; then accept the batch."""
        return self.extend(batch, number, number).drop("batch_no")

    def extend(self, rows: DataFrame, first: int, last: int, batch: str | None = None) -> DataFrame:
        """(record_key, batch_no, first_batch): the same for all batches from ``first`` to ``last``, told apart by the column ``batch``; all of them are accepted."""
        raise NotImplementedError

    def _manifests(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]

    def _read(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/manifests/{number:012d}.json"))

    def _load(self, number: int) -> dict[str, list[Segment]]:
        told = self._read(number)
        return {t: [Segment(**s | {"parts": tuple(s["parts"])}) for s in told[t]] for t in self.tables}

    def _before(self, first: int, last: int) -> dict[str, list[Segment]]:
        have = self._manifests()
        if have and first <= max(have) and (last != max(have) or self._read(last)["first"] != first):
            raise ValueError(f"batch {first} comes after batch {max(have)}")
        earlier = [n for n in have if n < first]
        return self._load(max(earlier)) if earlier else {t: [] for t in self.tables}

    def _accept(self, first: int, number: int, before: dict[str, list[Segment]], added: dict[str, Segment]) -> None:
        now = {t: table.merged([*before[t], added[t]]) for t, table in self.tables.items()}
        write_text(self.spark, f"{self.path}/manifests/{number:012d}.json", json.dumps({"first": first} | {t: [s.plain() for s in now[t]] for t in self.tables}))
        # the state before this batch stays, so that the batch can be added again
        for t, table in self.tables.items():
            table.forget([*before[t], *now[t]])
        for n in sorted(self._manifests())[:-2]:
            delete(self.spark, f"{self.path}/manifests/{n:012d}.json")

    def _answer(self, known: DataFrame, number: int) -> DataFrame:
        path = f"{self.path}/known/upto={number}"
        known.select("record_key", *(F.col(c).cast("int").alias(c) for c in ("batch_no", "first_batch"))).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(KNOWN).parquet(path)

    def known(self) -> DataFrame:
        """(record_key, batch_no, first_batch): the answers to all batches so far."""
        path = f"{self.path}/known"
        if not exists(self.spark, path):
            return no_rows(self.spark, KNOWN)
        return self.spark.read.schema(KNOWN).option("recursiveFileLookup", True).parquet(path)


class History(_Growing):
    """An index of accepted records by their text.

    The token order is frozen when the index is made, from ``sample`` (any rows, e.g. the
    first batch); it decides how long postings get, not what is found. Without a sample,
    the index at ``path`` is opened. ``hot``: rows of a unit that one task pairs at once.

    Likeness within a batch does not count. Equal texts are one entry of the index,
    under the first batch that had them. Null keys, null texts and texts without words are
    no case; a key given more than once in a batch has all its texts. A key
    accepted before should not come again: it would be near to itself.
    """

    def __init__(self, spark: SparkSession, path: str, like: Likeness, key: str, text: str, sample: DataFrame | None = None, *, hot: int = HOT, part_rows: int = PART_ROWS, fan_in: int = FAN_IN):
        super().__init__(spark, path)
        self.like, self.key, self.text, self.hot = like, key, text, hot
        posting = "unit bigint, id bigint, n int, pos int, map binary"
        self.tables = {
            "postings": Parted(spark, f"{path}/postings", posting, "unit", part_rows, fan_in),
            "sets": Parted(spark, f"{path}/sets", "id bigint, elements array<int>, batch int", "id", part_rows, fan_in),
        }
        if sample is not None:
            tokens, counts = prefixes.frequent_tokens(sample, key, text, like)
            rows = [(int(t), int(n)) for t, n in zip(tokens.view(np.int64), counts)]  # at most MOST_FREQUENT
            spark.createDataFrame(rows, "token bigint, n bigint").write.mode("overwrite").parquet(f"{path}/order")
        kept = spark.read.schema("token bigint, n bigint").parquet(f"{path}/order").toPandas()
        tokens = kept["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        self.order = tokens[order], kept["n"].to_numpy(np.int64)[order]

    def extend(self, rows: DataFrame, first: int, last: int, batch: str | None = None) -> DataFrame:
        before = self._before(first, last)
        with scratch(self.spark, "history") as own:
            number = (F.lit(first) if batch is None else F.col(batch)).cast("int").alias("batch")
            sets = materialise(prefixes.prepared(rows, self.key, self.text, number).mapInArrow(prefixes.indexer(self.like, *self.order), prefixes.SETS + ", batch int"), "sets", own)
            told = Observation()
            least = lambda c: F.coalesce(c, F.lit(0))
            found = prefixes.classes_of(sets, F.min("batch").alias("batch"), F.max("batch").alias("last"))
            classes = materialise(found.observe(told, F.count("*").alias("n"), least(F.sum(F.size("prefix"))).alias("postings"), least(F.max("size")).alias("largest")), "classes", own)
            total = told.get
            fresh, known = classes, no_rows(self.spark, KNOWN)
            if total["n"] and (before["postings"] or first < last):
                near = self._near(classes, first, before, total["postings"], own)
                # a class of several batches is itself an earlier one for the later of them
                again = classes.where(F.col("batch") < F.col("last")).select("id", "batch", F.lit(False).alias("same"))
                hits = materialise(near.unionByName(again).groupBy("id").agg(F.min("batch").alias("first_batch"), F.max("same").alias("same")), "hits", own)
                of = classes.select("id", "fp1", "fp2", "size").join(hits.drop("same"), "id")
                known = units.join_classes(sets.select("key", "fp1", "fp2", "batch"), of, ["fp1", "fp2"], largest=total["largest"]).where(F.col("first_batch") < F.col("batch"))
                known = known.groupBy(F.col("key").alias("record_key"), F.col("batch").alias("batch_no")).agg(F.min("first_batch").alias("first_batch"))
                fresh = classes.join(hits.where("same").select("id"), "id", "left_anti")
            with ThreadPoolExecutor(3) as pool:  # three jobs that don't need each other
                answer = pool.submit(self._answer, known, last)
                added = {
                    "postings": pool.submit(self.tables["postings"].write, prefixes.entries(fresh, F.lit(1)).drop("side"), total["postings"]),
                    "sets": pool.submit(self.tables["sets"].write, fresh.select("id", "elements", "batch"), total["n"]),
                }
            self._accept(first, last, before, {t: job.result() for t, job in added.items()})
        # what the run shuffled and broadcast is dropped once the driver has collected its handles
        self.spark._jvm.System.gc()
        return answer.result()

    def _near(self, classes: DataFrame, first: int, before: dict[str, list[Segment]], new_postings: int, own: str) -> DataFrame:
        """(id, batch, same): new classes with the batches of the accepted sets that are near, and of the new ones; whether an accepted one is equal."""
        # side 1 is the index; classes of one and the same batch don't pair, those of several do with all
        probe = prefixes.entries(classes, F.when(F.col("batch") == F.col("last"), F.col("batch") - first + 2).otherwise(0))
        both, rows = probe, new_postings
        if before["postings"]:
            held = sum(s.rows for s in before["postings"])
            rows += held
            old = self.tables["postings"].lookup(probe.select("unit"), before["postings"]).withColumn("side", F.lit(1))
            if new_postings * FEW < held:
                old = old.join(probe.select("unit").distinct(), "unit", "left_semi")
            both = old.unionByName(probe)
        if rows > self.hot:
            both = units.split_hot(materialise(both, "probe", own), self.hot)
        else:
            both = both.withColumn("role", F.lit(0))
        found = materialise(units.each_unit(both, prefixes.matcher(self.like, arrivals=True), "a bigint, b bigint").distinct(), "found", own)
        sets = classes.select("id", "elements", "batch", F.lit(False).alias("old"))
        if before["sets"]:
            sets = sets.unionByName(self.tables["sets"].lookup(found.select(F.col("b").alias("id")), before["sets"]).withColumn("old", F.lit(True)))
        near = prefixes.verified(found, classes.select("id", "elements", F.col("batch").alias("own")), sets, self.like)
        # of two new classes each is near to the other
        sides = F.array(F.struct(F.col("a").alias("id"), "batch", (F.col("old") & (F.col("similarity") == 1)).alias("same")), F.struct(F.col("b").alias("id"), F.col("own").alias("batch"), F.lit(False).alias("same")))
        return near.select(F.explode(F.when(F.col("old"), F.slice(sides, 1, 1)).otherwise(sides)).alias("r")).select("r.*")


class KnownIds(_Growing):
    """An index of accepted ids. ``name`` turns the id column into what it names; null names nothing."""

    def __init__(self, spark: SparkSession, path: str, key: str, record: str, name: Callable[[str], Column] = paper_key, *, part_rows: int = PART_ROWS, fan_in: int = FAN_IN):
        super().__init__(spark, path)
        self.key, self.record, self.name = key, record, name
        self.tables = {"ids": Parted(spark, f"{path}/ids", "unit bigint, token string, first_batch int", "unit", part_rows, fan_in)}

    def extend(self, rows: DataFrame, first: int, last: int, batch: str | None = None) -> DataFrame:
        """Rows with a null id or record key are no case; repeated rows each count."""
        before = self._before(first, last)
        with scratch(self.spark, "ids") as own:
            token = self.name(self.key)
            number = (F.lit(first) if batch is None else F.col(batch)).cast("int").alias("batch_no")
            rows = rows.select(F.col(self.record).cast("bigint").alias("record_key"), token.alias("token"), number).where("token is not null and record_key is not null")
            ids = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("batch_no").alias("batch"), F.max("batch_no").alias("last")).withColumn("unit", F.xxhash64("token"))
            held = self.tables["ids"].lookup(ids.select("unit"), before["ids"]).drop("unit")
            told = Observation()
            both = materialise(ids.join(held, "token", "left").observe(told, F.count("*").alias("n"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")), "both", own)
            earliest = F.coalesce("first_batch", "batch")
            seen = both.where(earliest < F.col("last")).select("token", "size", earliest.alias("first_batch"))
            fresh = both.where("first_batch is null").select("unit", "token", F.col("batch").alias("first_batch"))
            with ThreadPoolExecutor(2) as pool:  # two jobs that don't need each other
                answer = pool.submit(self._answer, units.join_classes(rows, seen, ["token"], largest=told.get["largest"]).where("first_batch < batch_no"), last)
                added = pool.submit(self.tables["ids"].write, fresh, told.get["n"])
            self._accept(first, last, before, {"ids": added.result()})
        return answer.result()


def _by_batch(df: DataFrame, batch: str, columns: list[str], key: str | None) -> tuple[str, StructType]:
    """(folder, schema of its rows): a table's rows by ``batch_no``, see ``batches_of``."""
    spark = df.sparkSession
    rows = df.where(F.col(batch).isNotNull()).select(F.col(batch).cast("int").alias("batch_no"), *columns)
    if key is not None:
        least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("batch_no", *[c for c in columns if c != key])).alias("_r"))
        rows = least.select(key, "_r.*")
    path = new_table_path(spark, "batches")
    rows.hint("rebalance", "batch_no").write.partitionBy("batch_no").parquet(path)
    return path, rows.select(*columns).schema


def batches_of(df: DataFrame, batch: str, columns: list[str], key: str | None = None) -> list[tuple[int, DataFrame]]:
    """(number, rows) of a table's batches in ascending order, each read from its own folder; rows without a batch are left out.

    With ``key``, a key delivered more than once is one row: that of its earliest batch, and the least of its contents there.
    """
    spark = df.sparkSession
    path, schema = _by_batch(df, batch, columns, key)
    numbers = sorted(int(n.removeprefix("batch_no=")) for n in names(spark, path) if n.startswith("batch_no="))
    return [(n, spark.read.schema(schema).parquet(f"{path}/batch_no={n}")) for n in numbers]


def runs_of(df: DataFrame, batch: str, columns: list[str], key: str | None = None) -> list[tuple[int, int, DataFrame]]:
    """(first, last, rows with their ``batch_no``) of a table's batches as runs for ``extend``: the first batch alone, then as many batches as have the rows of all before."""
    spark = df.sparkSession
    path, schema = _by_batch(df, batch, columns, key)
    if not any(n.startswith("batch_no=") for n in names(spark, path)):
        return []
    rows = spark.read.schema(schema.add("batch_no", IntegerType())).parquet(path)
    runs: list[tuple[int, int]] = []
    before, size = 0, 0
    for r in rows.groupBy("batch_no").count().orderBy("batch_no").collect():  # a row per batch
        if size < before:
            runs[-1] = runs[-1][0], r["batch_no"]
        else:
            before, size = before + size, 0
            runs.append((r["batch_no"], r["batch_no"]))
        size += r["count"]
    return [(a, b, rows.where(F.col("batch_no").between(a, b))) for a, b in runs]
