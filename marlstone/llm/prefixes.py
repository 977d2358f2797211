"""Exact similarity joins by rare-token prefixes.

A record is its bag of words as a set (see ``words.counted``) or its set of shingles.
Elements are put into one fixed order, rare before frequent. Two sets with Jaccard t or
more share an element among their first ``n - ceil(t * n) + 1`` ones, and the first one
they share is in both prefixes. So only prefixes are indexed, under the element and the
band of the set's size (a band is so wide that partners are at most one band apart, which
keeps sets of unlike sizes from meeting), or under the element alone where the matcher
cuts a unit by sizes itself (``entries``). Pairs that meet pass, without loss, a filter on
sizes, one on the places of the shared element (what follows it bounds the overlap) and
one on 256-bit bitmaps (which differ in at most as many bits as the sets differ in
elements). What is left is verified on the elements.

The order needs counts only for frequent elements: those with at least
``1 / MOST_FREQUENT`` of all, of which there can be at most MOST_FREQUENT. Others count
as rare and are ordered by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import units, words
from marlstone.llm.near_duplicates import Duplicates, Likeness, elements_of, fingerprints
from marlstone.session import materialise, whole_words

MOST_FREQUENT = 100_000
HOT = 20_000
#: From so many pairs of new and old rows on, a unit is compared as a block.
DENSE = 2048
#: Rows of a unit whose sizes are taken as one range; rows of either side compared at once, which stay in the cache.
RANGE_ROWS, BLOCK = 512, (128, 1024)
SETS = "key bigint, fp1 bigint, fp2 bigint, n int, prefix array<bigint>, map binary, elements array<int>"


def prepared(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), whole_words(text).alias("text"), *more)


def frequent_tokens(df: DataFrame, key: str, text: str, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(elements ascending by hash, their counts) of the frequent elements of all rows: at most MOST_FREQUENT."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 0):
            values, _ = elements_of(batch.column(0), like)
            token, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    counts = materialise(prepared(df, key, text).select("text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2, -(-total // MOST_FREQUENT))
    rows = counts.where(F.col("n") >= least).toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy(np.int64)[order]


def indexer(like: Likeness, tokens: np.ndarray, counts: np.ndarray):
    """A mapInArrow function from (key, text) to SETS; further columns are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 1):
            values, at = elements_of(batch.column(1), like)
            size = np.diff(at)
            keep = np.flatnonzero(size > 0)
            if len(keep) == 0:
                continue
            rows = words.rows_of(at)
            frequency = np.zeros(len(values), np.int64)
            if len(tokens):
                pos = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
                frequency = np.where(tokens[pos] == values, counts[pos], 0)
            order = np.lexsort((values, frequency, rows))
            place = np.arange(len(values)) - np.repeat(at[:-1], size)
            prefix = size - np.ceil(like.threshold * size - 1e-9).astype(np.int64) + 1
            head = place < np.repeat(prefix, size)
            bits = np.zeros((len(size), 256), np.uint8)
            np.bitwise_xor.at(bits, (rows, (words.mix(values) & np.uint64(255)).astype(np.int64)), 1)
            maps = np.packbits(bits, axis=1)[keep]
            lists = lambda flat, lengths: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    pa.array(fingerprints(values, at, 0)[keep].view(np.int64)),
                    pa.array(fingerprints(values, at, 0x5BD1E995)[keep].view(np.int64)),
                    pa.array(size[keep].astype(np.int32)),
                    lists(values[order][head].view(np.int64), prefix[keep]),
                    pa.array([bytes(x) for x in maps], pa.binary()),
                    lists((values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), size[keep]),
                    *(c.take(pa.array(keep)) for c in batch.columns[2:]),
                ],
                names=["key", "fp1", "fp2", "n", "prefix", "map", "elements", *batch.schema.names[2:]],
            )

    return run


def classes_of(sets: DataFrame, *more: Column) -> DataFrame:
    """One row per distinct set: (fp1, fp2, id, size, n, prefix, map, elements, more); id is its least key, size its number of rows."""
    return sets.groupBy("fp1", "fp2").agg(F.min("key").alias("id"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("n", "prefix", "map", "elements")], *more)


def band(n: Column, t: float) -> Column:
    """Sizes within a factor t of each other are in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.lit(1.0001 * math.log(1 / t)))


def postings(classes: DataFrame, t: float, away: tuple[int, ...] = (0,), side: Column | None = None) -> DataFrame:
    """(unit, id, n, pos, map, side): every prefix element in the bands ``away`` from the set's own; ``side`` may depend on ``away``."""
    p = classes.select("id", "n", "map", F.posexplode("prefix").alias("pos", "token"))
    p = p.withColumn("away", F.explode(F.array(*[F.lit(a) for a in away]))) if len(away) > 1 else p.withColumn("away", F.lit(away[0]))
    return p.select(F.xxhash64("token", band(F.col("n"), t) + F.col("away")).alias("unit"), "id", "n", "pos", "map", (F.lit(0) if side is None else side).cast("int").alias("side"))


def entries(classes: DataFrame, side: Column) -> DataFrame:
    """(unit, id, n, pos, map, side): every prefix element once, for sets of all sizes."""
    return classes.select(F.posexplode("prefix").alias("pos", "unit"), "id", "n", "map", side.cast("int").alias("side")).select("unit", "id", "n", "pos", "map", "side")


def _bound(nx, ny, t: float):
    """Most elements in which two sets of these sizes may differ at Jaccard t."""
    return np.floor((nx + ny) * (1 - t) / (1 + t) + 1e-9)


def matcher(like: Likeness, arrivals: bool = False):
    """Pairs (a, b) of a unit's rows that may be near. Rows of the same side, other than 0, don't pair. Side 1 is an index; a is not of it, or the lesser id.

    ``arrivals``: rows of all sides but 1 are new ones, to be met with the index and with each other.
    """
    t = like.threshold

    def work(tab: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, key, role, n, side, pos = (tab[c].to_numpy() for c in ("unit", "id", "role", "n", "side", "pos"))
        maps = words.fixed_bytes(tab["map"], 32).copy().view(np.uint64)
        order = np.lexsort((n, unit))
        unit, key, role, side, pos, n, maps = unit[order], key[order], role[order], side[order], pos[order], n[order].astype(np.int32), maps[order]
        first, second = np.ascontiguousarray(maps[:, 0]), np.ascontiguousarray(maps[:, 1])
        end, found = units.runs_of(unit), []
        # bits of sets that fall together cancel out, so that folded bitmaps differ in no more places than the sets in elements
        two = maps[:, 0] ^ maps[:, 2]
        one = two ^ maps[:, 1] ^ maps[:, 3]

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            ok = ((role[x] == 0) | (role[x] != role[y])) & ((side[x] == 0) | (side[x] != side[y])) & (n[y] * t <= n[x] + 1e-9)
            x, y = x[ok], y[ok]
            # the unit's element and what follows it in both are all that they can share, if it is the first they share
            ok = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= t / (1 + t) * (n[x] + n[y]) - 1e-9
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int32) <= _bound(n[x], n[y], t)
            x, y = x[ok], y[ok]
            if len(x):
                turn = np.where((side[x] == 1) | (side[y] == 1), side[x] == 1, key[x] > key[y])
                found.append(np.stack((np.where(turn, key[y], key[x]), np.where(turn, key[x], key[y])), axis=1))

        if arrivals or (side.any() and not (side == 0).any()):
            cross(unit, n, side, role, pos, one, two, keep)
            yield from found_pairs(found)
            return
        long = np.zeros(len(unit), bool)
        heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        for s in heads[end[heads] - heads > 64]:
            e = int(end[s])
            long[s:e] = True
            for i in range(int(s), e, 256):
                j = min(i + 256, e)
                # sizes ascend: partners of the block's largest set end where n exceeds n_max / t
                stop = int(s + np.searchsorted(n[s:e], np.floor(n[j - 1] / t + 1e-9), side="right"))
                # one bound per partner, that of the block's largest set: whole bytes, no floats per pair
                most = np.minimum(_bound(n[j - 1], n[i:stop], t), 255).astype(np.uint8)
                differ = np.bitwise_count(first[i:j, None] ^ first[None, i:stop])
                differ += np.bitwise_count(second[i:j, None] ^ second[None, i:stop])
                hit = np.flatnonzero((differ <= most).ravel())
                x, y = np.divmod(hit, stop - i)
                x, y = x + i, y + i
                up = x < y
                if up.any():
                    keep(x[up], y[up])
        rest = np.flatnonzero(~long)
        for x, y in units.pairs_in_runs(unit[rest]):
            x, y = rest[x], rest[y]
            near = (n[y] * t <= n[x] + 1e-9) & (np.bitwise_count(first[x] ^ first[y]) <= _bound(n[x], n[y], t))
            keep(x[near], y[near])
        yield from found_pairs(found)

    def cross(unit, n, side, role, pos, one, two, keep) -> None:
        """New rows with the old rows of their unit and with new rows of other sides, where sizes and places allow it: never two old ones, so a unit costs its new rows times its rows."""
        heads = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        is_new = side != 1
        among = bool(len(s := side[is_new])) and bool((s == 0).any() or (s != s[0]).any())
        news = np.add.reduceat(is_new, heads)
        ends = np.append(heads[1:], len(unit))
        olds = ends - heads - news
        dense = news * (olds + news if among else olds) >= DENSE
        for s, e in zip(heads[dense], ends[dense]):
            new, old = s + np.flatnonzero(is_new[s:e]), s + np.flatnonzero(~is_new[s:e])
            parts = [(0, 0)] if not role[s:e].any() else [(1, 2), (2, 1)]
            for mine, other in parts:
                a = new[role[new] == mine]
                block(a, old[role[old] == other], False, n, pos, one, two, keep)
                if among and mine <= other:
                    block(a, a if mine == other else new[role[new] == other], mine == other, n, pos, one, two, keep)
        # the small units together: each new row with its unit's old ones, and with the new ones after it
        small = np.repeat(~dense, ends - heads)
        rank = np.repeat(np.arange(len(heads)), ends - heads)
        new, old = np.flatnonzero(is_new & small), np.flatnonzero(~is_new & small)
        for others, after in ((old, False), (new, True)) if among else ((old, False),):
            if not len(new) or not len(others):
                continue
            low, high = np.searchsorted(rank[others], rank[new], side="left"), np.searchsorted(rank[others], rank[new], side="right")
            if after:
                low = np.arange(len(new)) + 1
            count = high - low
            total, begin = np.cumsum(count), 0
            while begin < len(new):
                # a slice of about PAIRS_AT_ONCE pairs; a row with more partners stands alone
                stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + units.PAIRS_AT_ONCE, side="right")))
                m = count[begin:stop]
                y = np.repeat(new[begin:stop], m)
                x = others[np.repeat(low[begin:stop] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))]
                keep(np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x))
                begin = stop

    def block(left, right, same: bool, n, pos, one, two, keep) -> None:
        """Rows of left with rows of right, by ranges of sizes: of two ranges, those rows meet whose places leave enough elements for the threshold, which are the first ones by place. With ``same``, right is left and a pair is met once."""
        if not len(left) or not len(right):
            return
        sizes, counts = np.unique(n[left] if same else np.concatenate((n[left], n[right])), return_counts=True)
        _, of = np.unique((np.cumsum(counts) - counts) // RANGE_ROWS, return_inverse=True)
        edges = np.arange(int(of[-1]) + 2)
        bounds = np.searchsorted(of, edges)
        low, high = sizes[bounds[:-1]], sizes[bounds[1:] - 1]
        c = t / (1 + t)
        room = np.empty(BLOCK[0] * BLOCK[1], np.uint64), np.empty(BLOCK[0] * BLOCK[1], np.uint8)

        def ranges(rows):
            at = of[np.searchsorted(sizes, n[rows])]
            order = np.lexsort((pos[rows], at))
            rows, cuts = rows[order], np.searchsorted(at[order], edges)
            return [(r, pos[r], one[r], two[r]) for r in (rows[cuts[i] : cuts[i + 1]] for i in edges[:-1])]

        mine = ranges(left)
        others = mine if same else ranges(right)
        for p, (rows, places, one_p, two_p) in enumerate(mine):
            if not len(rows):
                continue
            for q in range(p if same else int(np.searchsorted(high, low[p] * t - 1e-9)), int(np.searchsorted(low, high[p] / t + 1e-9, side="right"))):
                rows_q, places_q, one_q, two_q = others[q]
                # the place of a set of size n may be n - c * (n + m) at most, for a partner of size m
                i_end = int(np.searchsorted(places, np.floor(high[p] - c * (high[p] + low[q]) + 1e-9), side="right"))
                j_end = int(np.searchsorted(places_q, np.floor(high[q] - c * (high[q] + low[p]) + 1e-9), side="right"))
                most = np.uint8(min(_bound(high[p], high[q], t), 255))
                for i in range(0, i_end, BLOCK[0]):
                    i_to = min(i + BLOCK[0], i_end)
                    for j in range(0, j_end, BLOCK[1]):
                        j_to = min(j + BLOCK[1], j_end)
                        if same and p == q and j_to <= i:
                            continue
                        shape = i_to - i, j_to - j
                        bits, differ = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
                        np.bitwise_xor(one_p[i:i_to, None], one_q[None, j:j_to], out=bits)
                        np.bitwise_count(bits, out=differ)
                        hit = np.flatnonzero(differ <= most)
                        if not len(hit):
                            continue
                        x, y = np.divmod(hit, shape[1])
                        x, y = x + i, y + j
                        halves = two_p[x] ^ two_q[y]
                        near = np.bitwise_count(halves) + np.bitwise_count(halves ^ bits.ravel()[hit]) <= most
                        if same and p == q:
                            near &= x < y
                        x, y = x[near], y[near]
                        if not len(x):
                            continue
                        x, y = rows[x], rows_q[y]
                        keep(np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x))

    return work


def found_pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, like: Likeness) -> DataFrame:
    """(a, b, similarity, and what else ``left`` and ``right`` have) of the pairs whose elements, looked up in left for a and right for b, reach the threshold."""
    return (
        pairs.join(left.withColumnsRenamed({"id": "a", "elements": "ea"}), "a")
        .join(right.withColumnsRenamed({"id": "b", "elements": "eb"}), "b")
        .withColumn("both", F.size(F.array_intersect("ea", "eb")))
        .withColumn("similarity", F.col("both") / (F.size("ea") + F.size("eb") - F.col("both")))
        .where(F.col("similarity") >= like.threshold - 1e-9)
        .drop("both", "ea", "eb")
    )


def exact_duplicates(df: DataFrame, key: str, text: str, like: Likeness, hot: int = HOT) -> Duplicates:
    """``near_duplicates`` without loss: all near pairs between the classes of equal records, by the same rules for nulls and repeats.

    Costs more than the tables of minhashes where many sets share their rarest elements.
    """
    tokens, counts = frequent_tokens(df, key, text, like)
    sets = materialise(prepared(df, key, text).mapInArrow(indexer(like, tokens, counts), SETS), "sets")
    classes = materialise(classes_of(sets), "classes")
    largest = classes.agg(F.max("size")).first()[0] or 0
    members = units.join_classes(sets.select("key", "fp1", "fp2"), classes.select("fp1", "fp2", F.col("id").alias("rep"), "size"), ["fp1", "fp2"], largest).select("key", "rep").distinct()
    # a set is at home in its own band and a guest in the next one, where guests don't pair with each other
    rows = postings(classes, like.threshold, (0, 1), F.when(F.col("away") == 1, 2).otherwise(0))
    found = units.each_unit(units.split_hot(rows, hot), matcher(like), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = classes.select("id", "elements")
    near = verified(found, own, own, like).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return Duplicates(materialise(members, "members"), classes.select(F.col("id").alias("rep"), "size"), largest, materialise(near, "near-pairs"))
