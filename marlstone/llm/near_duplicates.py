"""Near-duplicate records: tensored minhash banding, verified exactly.

Method. Each record becomes a set: its bag of words (the j-th occurrence of a
word is an element of its own, so set Jaccard is multiset Jaccard) or its
distinct runs of ``k`` words. Two small collections of minhash groups, A and B,
of ``half`` groups with ``rows`` minhashes each, are combined pairwise: table
(i, j) is keyed by group A_i together with group B_j. That gives ``half**2``
tables of ``2 * rows`` minhashes from ``2 * half * rows`` hash functions, about
the square root of what independent tables need. A table is never written out:
rows are sent to their A_i group once, with the signature, and the B_j groups
are matched inside it. Candidates pass a minhash estimate with a margin of 3.5
standard deviations and are then verified on the element sets.

Equal element sets are collapsed to one representative first, so copies are
never paired with each other here; ``members`` maps every record to its class.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.llm import units, words
from marlstone.session import materialise, whole_words


@dataclass(frozen=True)
class Likeness:
    """What counts as near: ``bag`` or ``shingles`` of ``k`` words, at Jaccard ``threshold`` or more.

    half and rows set the tables; a pair at similarity s is found with
    probability ``(1 - (1 - s**rows) ** half) ** 2``.
    """

    kind: str
    threshold: float
    half: int
    rows: int
    k: int = 5

    @property
    def hashes(self) -> int:
        return 2 * self.half * self.rows

    @property
    def least_equal(self) -> int:
        """Equal minhashes that a pair at the threshold falls short of once in some 4000 times."""
        t, n = self.threshold, self.hashes
        return max(1, int(np.floor(n * t - 3.5 * np.sqrt(n * t * (1 - t)))))


#: Five-word shingles at 0.8: the default for texts.
TEXTS = Likeness("shingles", 0.8, half=12, rows=4)
#: Rows of one bucket that a task pairs at once; larger ones are cut into blocks.
HOT = 20_000

SKETCH = "key bigint, fp1 bigint, fp2 bigint, n int, buckets array<bigint>, sig binary, elements array<int>"


def elements_of(texts: pa.Array, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Each text's element set as 64-bit hashes with offsets."""
    w, at = words.word_hashes(texts)
    return words.counted(w, at) if like.kind == "bag" else words.shingles(w, at, like.k)


def fingerprints(values: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    """Order-free 64-bit hash of each row's set."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            out[full] = words.mix(np.add.reduceat(words.mix(values ^ np.uint64(salt)), at[:-1][full]))
    return out


def _sketcher(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = words.seeds(like.hashes, 20)
        for batch in words.bounded(batches, 1):
            values, at = elements_of(batch.column(1), like)
            size = np.diff(at)
            keep = np.flatnonzero(size > 0)
            if len(keep) == 0:
                continue
            m = words.minhashes(values, at, seeds)[keep]
            groups = np.zeros((len(keep), like.half), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(like.half):
                    h = np.full(len(keep), i + 1, np.uint64)
                    for j in range(like.rows):
                        h = words.mix(h * np.uint64(0x100000001B3) + m[:, i * like.rows + j])
                    groups[:, i] = h
            low = np.ascontiguousarray((m & np.uint32(0xFF)).astype(np.uint8))
            # rows without elements have no values, so the kept rows' values are the whole array
            offsets = np.concatenate(([0], np.cumsum(size[keep]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    pa.array(fingerprints(values, at, 0)[keep].view(np.int64)),
                    pa.array(fingerprints(values, at, 0x5BD1E995)[keep].view(np.int64)),
                    pa.array(size[keep].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(keep) * like.half + 1, like.half, dtype=np.int32)), pa.array(groups.ravel().view(np.int64))),
                    pa.array([bytes(x) for x in low], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array((values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))),
                ],
                names=["key", "fp1", "fp2", "n", "buckets", "sig", "elements"],
            )

    return run


def sketch(df: DataFrame, key: str, text: str, like: Likeness) -> DataFrame:
    """One row per record that has elements. Null keys, null texts and texts without (enough) words have no row."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), whole_words(text).alias("text"))
    return rows.mapInArrow(_sketcher(like), SKETCH)


def _second(sig: np.ndarray, like: Likeness, j: int, base: np.ndarray) -> np.ndarray:
    """Hash of group B_j of each signature, on top of ``base``."""
    with np.errstate(over="ignore"):
        for i in range(like.rows):
            base = base * np.uint64(0x100000001B3) + sig[:, (like.half + j) * like.rows + i].astype(np.uint64) + np.uint64(1)
    return base


def _alike(like: Likeness, sig: np.ndarray, key: np.ndarray, role: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """The pairs of places (x, y) whose signatures agree enough, as ordered keys."""
    ok = (role[x] == 0) | (role[x] != role[y])
    x, y = x[ok], y[ok]
    for s in range(0, len(x), 1 << 17):  # bounds the compared signatures
        p, q = x[s : s + (1 << 17)], y[s : s + (1 << 17)]
        near = (sig[p] == sig[q]).sum(axis=1, dtype=np.int32) >= like.least_equal
        if near.any():
            u, v = key[p[near]], key[q[near]]
            yield np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1)


def _distinct_pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _candidates(like: Likeness):
    """Pairs of rows that share a group A_i (the unit) and, looked up here, a group B_j."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, key, role = t["unit"].to_numpy(), t["id"].to_numpy(), t["role"].to_numpy()
        sig = words.fixed_bytes(t["sig"], like.hashes)
        base = words.mix(unit.view(np.uint64))
        found: list[np.ndarray] = []
        for j in range(like.half):
            b = _second(sig, like, j, base)
            order = np.argsort(b, kind="stable")
            for x, y in units.pairs_in_runs(b[order]):
                found += _alike(like, sig, key, role, order[x], order[y])
        yield from _distinct_pairs(found)

    return work


def _table_pairs(like: Likeness):
    """Pairs of rows that share a table's key (the unit)."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, key, role = t["unit"].to_numpy(), t["id"].to_numpy(), t["role"].to_numpy()
        sig = words.fixed_bytes(t["sig"], like.hashes)
        found: list[np.ndarray] = []
        for x, y in units.pairs_in_runs(unit):
            found += _alike(like, sig, key, role, x, y)
        yield from _distinct_pairs(found)

    return work


def _to_tables(like: Likeness):
    """Rows of a group A_i to the keys of the tables (A_i, B_j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = words.fixed_bytes(batch.column(2), like.hashes)
            base = words.mix(batch.column(0).to_numpy().view(np.uint64))
            for j in range(like.half):
                yield pa.RecordBatch.from_arrays([pa.array(words.mix(_second(sig, like, j, base) + np.uint64(j)).view(np.int64)), batch.column(1), batch.column(2)], names=["unit", "id", "sig"])

    return run


def _found(rows: DataFrame, like: Likeness, hot: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (unit, id, sig). Groups of more than ``hot`` rows are spread over their tables, and tables that still are over blocks."""
    pair = "a bigint, b bigint"
    large = materialise(rows.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("unit"), "hot-groups")
    if not large.take(1):  # as in most tables
        return units.each_unit(rows.withColumn("role", F.lit(0)), _candidates(like), pair)
    small = rows.join(large, "unit", "left_anti").withColumn("role", F.lit(0))
    spread = materialise(rows.join(large, "unit", "left_semi").select("unit", "id", "sig").mapInArrow(_to_tables(like), "unit bigint, id bigint, sig binary"), "tables")
    return units.each_unit(small, _candidates(like), pair).unionByName(units.each_unit(units.split_hot(spread, hot), _table_pairs(like), pair))


@dataclass
class Duplicates:
    """members: (key, rep), each record's class; classes: (rep, size), ``largest`` the greatest size; pairs: (a, b, similarity), near representatives, a < b."""

    members: DataFrame
    classes: DataFrame
    largest: int
    pairs: DataFrame


def near_duplicates(df: DataFrame, key: str, text: str, like: Likeness = TEXTS, hot: int = HOT) -> Duplicates:
    """Classes of equal records and all near pairs between the classes.

    ``key`` must identify a record; a key that occurs more than once counts as one
    record (with differing texts, all its texts count). Records with a null key, a
    null text or no elements belong to no class. Extra columns are ignored. An empty
    table gives empty results. Ties do not arise: representatives are the least keys.
    """
    sketched = materialise(sketch(df, key, text, like), "sketch")
    told = Observation()
    grouped = sketched.groupBy("fp1", "fp2").agg(F.min("key").alias("rep"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("sig", "buckets")])
    classes = materialise(grouped.observe(told, F.coalesce(F.max("size"), F.lit(0)).alias("largest")), "classes")
    largest = told.get["largest"]
    members = units.join_classes(sketched.select("key", "fp1", "fp2"), classes.select("fp1", "fp2", "rep", "size"), ["fp1", "fp2"], largest).select("key", "rep").distinct()
    found = _found(classes.select(F.explode("buckets").alias("unit"), F.col("rep").alias("id"), "sig"), like, hot).distinct()
    # elements are read from the sketches, not carried through the grouping
    sets = sketched.select("key", "elements")
    pairs = (
        found.join(sets.select(F.col("key").alias("a"), F.col("elements").alias("ea")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("elements").alias("eb")), "b")
        .withColumn("both", F.size(F.array_intersect("ea", "eb")))
        .withColumn("similarity", F.col("both") / (F.size("ea") + F.size("eb") - F.col("both")))
        .where(F.col("similarity") >= like.threshold)
        .groupBy("a", "b")
        .agg(F.max("similarity").alias("similarity"))
    )
    with ThreadPoolExecutor(2) as pool:  # two jobs that don't need each other
        done = [pool.submit(materialise, df, name) for df, name in ((members, "members"), (pairs, "near-pairs"))]
    return Duplicates(done[0].result(), classes.select("rep", "size"), largest, done[1].result())


def record_pairs(found: Duplicates, limit: int = 10_000) -> DataFrame:
    """All near pairs of records (key_a < key_b), those of equal records too.

    The number of rows is that of the pairs, so a class of n equal records gives
    n * (n - 1) / 2; use ``groups`` where that is not wanted. A class of more than ``limit``
    records is cut into blocks, each of which meets the class in a task of its own.
    """
    m = found.members
    a, b = m.select(F.col("rep").alias("a"), F.col("key").alias("x")), m.select(F.col("rep").alias("b"), F.col("key").alias("y"))
    across = found.pairs.select("a", "b").join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    if found.largest <= limit:
        within = a.join(b, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("key_a"), F.col("y").alias("key_b"))
        return across.unionByName(within).distinct()
    several = found.classes.where("size > 1").groupBy("rep").agg(F.sum("size").alias("size"), F.ceil(F.sum("size") / limit).cast("int").alias("blocks"))
    inside = materialise(units.join_classes(m, several, ["rep"], found.largest), "copies")
    left = inside.select("rep", F.col("key").alias("key_a"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    right = inside.select("rep", F.col("key").alias("key_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    within = left.join(right, ["rep", "block"]).where("key_a < key_b").select("key_a", "key_b")
    return across.unionByName(within).distinct()


def components(pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """Connected components of ``pairs`` (a, b): rows (node, root), root the least node. Nodes without a pair are left out.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each written to the shared folder.
    Ends when a round changes nothing, after a logarithmic number of rounds. With ``rounds``, raises
    where that many are not enough: groups are never given unfinished.
    """
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = materialise(edges, "edges")
    last = None
    for done in itertools.count(1):
        if rounds is not None and done > rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u != v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == last:
            break
        last = state
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def groups(found: Duplicates) -> DataFrame:
    """(key, group_id, links): one row per record; its group is named by the least key, links counts near classes."""
    roots = components(found.pairs).withColumnRenamed("node", "rep")
    degree = found.pairs.select(F.col("a").alias("rep")).union(found.pairs.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    each = found.classes.groupBy("rep").agg(F.sum("size").alias("size")).join(roots, "rep", "left").join(degree, "rep", "left")
    return units.join_classes(found.members, each, ["rep"], found.largest).select("key", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
