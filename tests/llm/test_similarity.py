"""Near-duplicates, history and groups against brute force and by hand."""

import random
import re
from collections import Counter
from dataclasses import replace
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import history, near_duplicates, prefixes, units, words
from marlstone.llm.near_duplicates import Likeness
from marlstone.session import new_table_path

BAG = Likeness("bag", 0.7, half=12, rows=3)
RUNS = Likeness("shingles", 0.5, half=14, rows=2)


def cut(t):
    return re.findall("[a-z0-9]+", t.lower())


def likeness(a, b, like):
    if like.kind == "bag":
        x, y = Counter(cut(a)), Counter(cut(b))
    else:
        x, y = (Counter({tuple(w[i : i + like.k]): 1 for i in range(len(w) - like.k + 1)}) for w in (cut(a), cut(b)))
    return sum((x & y).values()) / sum((x | y).values()) if x and y else 0.0


def corpus(n=120, seed=3):
    """Texts from shared phrases, with edited, repeated, empty and null ones."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.5 and (base := cut(rnd.choice(texts) or "")):
            for _ in range(rnd.randint(0, 9)):
                base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append(" ".join(base).title() + "!")
        else:
            texts.append(" ".join(rnd.choices(vocabulary, k=rnd.randint(20, 60))))
    return texts + [texts[0]] * 4 + ["", "?!", None, None, "one two"]


def frame(spark, texts, batches=None):
    rows = [(i, t, batches[i] if batches else 1, "x", 1, 2) for i, t in enumerate(texts)]
    # columns with names that the operators use inside
    return spark.createDataFrame(rows, "row_id bigint, body string, month int, unit string, key int, id int").withColumnsRenamed({"row_id": "my_id"})


def all_pairs(texts, like):
    live = [(i, t) for i, t in enumerate(texts) if t]
    return {(i, j) for i, a in live for j, b in live if i < j and likeness(a, b, like) >= like.threshold - 1e-12}


@pytest.mark.parametrize("like", [BAG, RUNS])
@pytest.mark.parametrize("hot", [20_000, 3])
def test_pairs_against_brute_force(spark, like, hot):
    """Also with every bucket of more than 3 rows cut into blocks."""
    texts = corpus()
    like = replace(like, half=24)
    found = near_duplicates.near_duplicates(frame(spark, texts), "my_id", "body", like, hot=hot)
    got = {tuple(r) for r in near_duplicates.record_pairs(found).collect()}
    assert got == all_pairs(texts, like)


def test_copies_are_never_paired(spark):
    """A hot group of equal records is one class: no pair, one group, whatever its size."""
    found = near_duplicates.near_duplicates(frame(spark, ["the same text of six words"] * 3000), "my_id", "body", BAG)
    assert found.pairs.count() == 0
    got = near_duplicates.groups(found).collect()
    assert len(got) == 3000 and {(r["group_id"], r["links"]) for r in got} == {(0, 0)}


def test_a_large_class_is_cut_into_blocks(spark):
    found = near_duplicates.near_duplicates(frame(spark, ["the same text of six words"] * 60 + ["the same text of six terms"] * 2), "my_id", "body", replace(BAG, half=24))
    assert found.largest == 60
    for limit in (10_000, 7):
        assert near_duplicates.record_pairs(found, limit).count() == 62 * 61 // 2


def test_empty_and_worthless_input(spark):
    for texts in ([], [None, "", "?"]):
        found = near_duplicates.near_duplicates(frame(spark, texts), "my_id", "body", BAG)
        assert found.members.count() == 0 and near_duplicates.record_pairs(found).count() == 0 and near_duplicates.groups(found).count() == 0
        exact = prefixes.exact_duplicates(frame(spark, texts), "my_id", "body", BAG)
        assert exact.members.count() == 0 and exact.pairs.count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    found = near_duplicates.near_duplicates(frame(spark, [long, long + " more", "short one"]), "my_id", "body", RUNS)
    assert {tuple(r) for r in near_duplicates.record_pairs(found).collect()} == {(0, 1)}


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A, b c d")], "k bigint, t string")
    found = near_duplicates.near_duplicates(df, "k", "t", BAG)
    assert [tuple(r) for r in near_duplicates.record_pairs(found).collect()] == [(1, 2)]
    assert sorted(tuple(r) for r in found.members.collect()) == [(1, 1), (2, 1)]


def test_components_are_never_unfinished(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError, match="not complete after 2"):
        near_duplicates.components(chain, rounds=2)
    assert {r["root"] for r in near_duplicates.components(chain).collect()} == {0}


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 105), (105, 100)] + [tuple(sorted(rnd.sample(range(200, 260), 2))) for _ in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in near_duplicates.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


@pytest.mark.parametrize("hot", [20_000, 3])
@pytest.mark.parametrize("like", [BAG, RUNS])
def test_exact_pairs_against_brute_force(spark, like, hot):
    texts = corpus(seed=5)
    found = prefixes.exact_duplicates(frame(spark, texts), "my_id", "body", like, hot=hot)
    assert {tuple(r) for r in near_duplicates.record_pairs(found).collect()} == all_pairs(texts, like)


@pytest.mark.parametrize("hot, part_rows", [(20_000, 1 << 18), (3, 20)])
def test_history_against_brute_force(spark, hot, part_rows):
    """Batch by batch, also with small parts, merged segments and every unit of more than 3 rows cut into blocks."""
    texts = corpus(seed=7)
    rnd = random.Random(2)
    batches = [rnd.choice([1, 2, 3, 4, 5, None]) for _ in texts]
    df = frame(spark, texts, batches)
    path = new_table_path(spark, "index")
    history.History(spark, path, BAG, "my_id", "body", sample=df.where("month = 1"))
    for b in (1, 2, 3, 3, 4, 5):  # one of them again: it replaces itself
        index = history.History(spark, path, BAG, "my_id", "body", hot=hot, part_rows=part_rows, fan_in=3)
        index.add(df.where(F.col("month") == b), b)
    want = {}
    for i, j in all_pairs(texts, BAG):
        for x, y in ((i, j), (j, i)):
            if batches[x] and batches[y] and batches[y] < batches[x]:
                want[x] = min(want.get(x, 9), batches[y])
    assert {(r["record_key"], r["batch_no"], r["first_batch"]) for r in index.known().collect()} == {(k, batches[k], v) for k, v in want.items()}
    # the index holds each text once
    held = index._load(5)["sets"]
    sets = [tuple(r["elements"]) for r in spark.read.option("recursiveFileLookup", True).parquet(*[f"{path}/sets/{s.name}" for s in held]).collect()]
    assert len(sets) == len(set(sets))
    with pytest.raises(ValueError, match="comes after"):
        index.add(df, 4)


@pytest.mark.parametrize("dense", [1, 10**9])
def test_new_rows_meet_old_ones_only(monkeypatch, dense):
    """All near pairs across the sides of a unit and none within one, as blocks and one by one."""
    monkeypatch.setattr(prefixes, "DENSE", dense)
    rng = np.random.default_rng(4)
    n = rng.integers(5, 15, 400).astype(np.int32)
    unit, side, maps = rng.integers(0, 9, 400), rng.integers(1, 3, 400).astype(np.int32), rng.integers(0, 2, (400, 256)).astype(np.uint8)
    maps[:, 10:] = 0
    tab = pa.table({"unit": unit, "id": np.arange(400), "role": np.zeros(400, np.int32), "n": n, "side": side, "pos": np.zeros(400, np.int32), "map": pa.array([bytes(x) for x in np.packbits(maps, axis=1)], pa.binary())})
    got = {(a, b) for batch in prefixes.matcher(BAG)(tab) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    near = lambda i, j: min(n[i], n[j]) >= 0.7 * max(n[i], n[j]) - 1e-9 and (maps[i] != maps[j]).sum() <= np.floor((n[i] + n[j]) * 0.3 / 1.7 + 1e-9)
    assert got == {(i, j) for i in range(400) for j in range(400) if side[i] == 2 and side[j] == 1 and unit[i] == unit[j] and near(i, j)}


def test_history_without_batches_or_texts(spark):
    df = frame(spark, [None, "", "?"])
    index = history.History(spark, new_table_path(spark, "index"), BAG, "my_id", "body", sample=df)
    assert index.known().count() == 0
    assert index.add(df, 1).count() == 0 and index.add(df, 2).count() == 0
    assert history.batches_of(df.limit(0), "month", ["my_id", "body"]) == []


def test_a_batch_reads_its_own_parts(spark):
    """A fixed batch opens as many bytes of a history ten times as long."""
    rnd = random.Random(3)

    def texts(n):
        return spark.createDataFrame([(rnd.randrange(1 << 40), " ".join(f"w{rnd.randrange(40_000)}" for _ in range(12))) for _ in range(n)], "k bigint, t string")

    batch, opened = texts(3), {}
    for size in (1000, 10_000):
        index = history.History(spark, new_table_path(spark, "index"), BAG, "k", "t", sample=texts(10), part_rows=64)
        index.add(texts(size), 1)
        probe = prefixes.postings(prefixes.classes_of(prefixes.prepared(batch, "k", "t").mapInArrow(prefixes.indexer(BAG, *index.order), prefixes.SETS)), BAG.threshold, (-1, 0, 1))
        files = index.tables["postings"].lookup(probe.select("unit"), index._load(1)["postings"]).inputFiles()
        opened[size] = sum(Path(f.removeprefix("file:")).stat().st_size for f in map(unquote, files))
        assert index.add(batch, 2).count() == 0
    assert opened[10_000] < 2 * opened[1000]


def test_known_ids(spark):
    same = ["2307.0000015v1", "2307.0000015", " arXiv:2307.0000015v12 ", "https://preprints.example/abs/2307.0000015v3/", "2307.0000015V2", "http://x.org/pdf/2307.0000015v1.pdf"]
    df = spark.createDataFrame([(i, s, i) for i, s in enumerate([*same, None, "", "2307.0000016v1"])], "n bigint, paper string, b int")
    assert {r["k"] for r in df.limit(len(same)).select(history.paper_key("paper").alias("k")).collect()} == {"2307.0000015"}
    index = history.KnownIds(spark, new_table_path(spark, "ids"), "paper", "n", part_rows=1, fan_in=2)
    for number, batch in history.batches_of(df, "b", ["n", "paper"]):
        index.add(batch, number)
    assert {tuple(r) for r in index.known().collect()} == {(i, i, 0) for i in range(1, len(same))}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_runs_of_batches_have_the_answers_of_each(spark, hot):
    """Batches added together, the last run twice: each pair of batches counts, none within a batch; equal texts of several batches of a run too."""
    texts = corpus(seed=9) + ["the same words in every batch of the run here"] * 5
    rnd = random.Random(4)
    batches = [rnd.choice([1, 2, 3, 4, 5]) for _ in texts[:-5]] + [1, 2, 3, 4, 5]
    df = frame(spark, texts, batches)
    index = history.History(spark, new_table_path(spark, "index"), BAG, "my_id", "body", sample=df.where("month = 1"), hot=hot)
    ids = history.KnownIds(spark, new_table_path(spark, "ids"), "body", "my_id", name=F.col)
    for a, b in ((1, 1), (2, 3), (4, 5), (4, 5)):
        for x in (index, ids):
            x.extend(df.where(F.col("month").between(a, b)), a, b, "month")
    want, equal = {}, {}
    for i, j in all_pairs(texts, BAG):
        for x, y in ((i, j), (j, i)):
            if batches[y] < batches[x]:
                want[x] = min(want.get(x, 9), batches[y])
    for x, t in enumerate(texts):
        earlier = [b for u, b in zip(texts, batches) if t is not None and u == t and b < batches[x]]
        if earlier:
            equal[x] = min(earlier)
    for got, right in ((index, want), (ids, equal)):
        assert sorted(map(tuple, got.known().collect())) == sorted((k, batches[k], v) for k, v in right.items())
        for a, b in ((3, 3), (5, 5), (3, 5)):
            with pytest.raises(ValueError, match="comes after"):
                got.extend(df, a, b, "month")


def test_few_runs_for_many_batches(spark):
    """Runs grow with what is there, so an index is not read anew for each of many batches."""
    df = spark.range(1800).selectExpr("id as k", "cast(id % 18 as int) as b")
    runs = history.runs_of(df, "b", ["k"])
    assert [r[:2] for r in runs] == [(0, 0), (1, 1), (2, 3), (4, 7), (8, 15), (16, 17)]
    assert sorted(map(tuple, runs[2][2].select("k", "batch_no").collect())) == [(i, i % 18) for i in range(1800) if i % 18 in (2, 3)]
    assert history.runs_of(df.limit(0), "b", ["k"]) == []


@pytest.mark.parametrize("dense, range_rows", [(1, 7), (1, 10**9), (10**9, 7)])
@pytest.mark.parametrize("roles", [1, 3])
def test_rows_meet_by_size_and_place(monkeypatch, dense, range_rows, roles):
    """Old rows, rows of two new batches and of several; ranges of sizes and places lose no pair."""
    monkeypatch.setattr(prefixes, "DENSE", dense)
    monkeypatch.setattr(prefixes, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(prefixes, "BLOCK", (5, 8))
    rng = np.random.default_rng(6)
    n = rng.integers(5, 30, 400).astype(np.int32)
    pos = (rng.random(400) * 0.3 * n).astype(np.int32)
    unit, side, role = rng.integers(0, 5, 400), rng.integers(0, 4, 400).astype(np.int32), rng.integers(0, roles, 400).astype(np.int32)
    role = np.where(unit < 2, role, 0).astype(np.int32)
    if roles > 1:
        role[unit < 2] = np.maximum(role[unit < 2], 1)
    maps = rng.integers(0, 2, (400, 256)).astype(np.uint8)
    maps[:, 12:] = 0
    tab = pa.table({"unit": unit, "id": np.arange(400), "role": role, "n": n, "side": side, "pos": pos, "map": pa.array([bytes(x) for x in np.packbits(maps, axis=1)], pa.binary())})
    got = {(a, b) for batch in prefixes.matcher(BAG, arrivals=True)(tab) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}

    def may(i, j):
        if i == j or unit[i] != unit[j] or (role[i] and role[i] == role[j]) or (side[i] == side[j] and side[i]) or side[i] == 1 or (side[j] != 1 and i > j):
            return False
        total = int(n[i] + n[j])
        return min(n[i], n[j]) >= 0.7 * max(n[i], n[j]) - 1e-9 and min(n[i] - pos[i], n[j] - pos[j]) >= 0.7 / 1.7 * total - 1e-9 and (maps[i] != maps[j]).sum() <= np.floor(total * 0.3 / 1.7 + 1e-9)

    assert got == {(i, j) for i in range(400) for j in range(400) if may(i, j)} and len(got) > 100


def test_a_key_delivered_again_is_one_record(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "c", 1), (None, "a", 1), (2, "a", None)], "k bigint, t string, b int")
    got = {n: [tuple(r) for r in rows.collect()] for n, rows in history.batches_of(df, "b", ["k", "t"], key="k")}
    assert got == {1: [(1, "a")]}


def test_hot_classes_are_spread(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("c"), "id")
    classes = rows.groupBy("c").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    got = units.join_classes(rows, classes, ["c"], limit=50)
    assert sorted(map(tuple, got.select("id", "least").collect())) == [(i, 0 if i < 900 else i) for i in range(1000)]


def test_units_of_a_stream_stay_whole(spark):
    """Tables handed on hold whole units, also where they are larger than what is asked for."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("unit"), "id")

    def work(t):
        u = t["unit"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(u)), pa.array(np.unique(u, return_counts=True)[1])], names=["unit", "n"])

    got = units.each_unit(rows, work, "unit bigint, n bigint", rows_at_once=100).collect()
    assert len(got) == 7 and sum(r["n"] for r in got) == 5000


def test_pairs_in_runs(monkeypatch):
    monkeypatch.setattr(units, "PAIRS_AT_ONCE", 4)
    keys = np.array([1, 1, 1, 2, 3, 3])
    got = {(int(a), int(b)) for x, y in units.pairs_in_runs(keys) for a, b in zip(x, y)}
    assert got == {(0, 1), (0, 2), (1, 2), (4, 5)} and not list(units.pairs_in_runs(keys[:0]))


def test_words_by_pattern():
    texts = ["Ab c-1", "", None, "äb ﬁ x", "tail", "a" * 5000 + " a"]
    low = pa.array([None if t is None else t.lower() for t in texts])
    h, at = words.word_hashes(low)
    plain = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    assert [int(x) for x in np.diff(at)] == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len({int(x) for x in h}) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    # a slice of a longer column gives the same
    assert (words.word_hashes(low.slice(3))[0] == h[at[3] :]).all()
