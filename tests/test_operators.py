import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators import accuracy, rows, stages
from marlstone.session import new_table_path, shared_dir
from marlstone.sources import files
from marlstone.streaming import incremental


def test_keep_first_counts_null_as_a_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3), ("a", 3)], "k string, n int")
    assert sorted(map(tuple, rows.keep_first(df, ["k"], [F.col("n")]).collect()), key=str) == [("a", 3), (None, 1)]


def test_wide_numbers_equal_plain_ones(spark):
    """One group holds most rows and is spread over several partitions."""
    df = spark.range(4000).select(F.when(F.col("id") % 9 == 0, F.col("id") % 5).when(F.col("id") % 7 > 0, F.lit(77)).alias("g"), F.xxhash64("id").alias("o"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows.numbered_wide(df, ["g"], ["o", "id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = rows.numbered(df, ["g"], [F.col("o"), F.col("id")]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_append_twice_changes_nothing(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "old")], [(1, "new"), (2, "new")]))
    once = rows.append(old, new, ["k"])
    assert sorted(map(tuple, rows.append(once, new, ["k"]).collect())) == [(1, "old"), (2, "new")]
    assert rows.append(old, new).count() == 3


def test_lookup_of_a_large_dimension_is_not_broadcast(spark):
    dim = spark.range(rows.DIMENSION_ROWS + 5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    got = rows.with_lookup(spark.createDataFrame([(3,), (-1,)], "k bigint"), dim, "k", "v", F.lit("none"))
    assert "BroadcastHint" not in str(rows.dimension(dim)._jdf.queryExecution().logical()) and sorted(r["v"] for r in got.collect()) == ["none", "x"]


def test_segments_of_nothing(spark):
    df = spark.createDataFrame([], "before_cutoff boolean, num_blanks bigint, total_exact_match bigint, exact_blanks bigint, total_binary_score bigint, sum_f1 double, avg_f1_score double, avg_rouge_score double, avg_bleu_score double")
    got = accuracy.segments(df).collect()
    assert sorted(r["segment"] for r in got) == ["after_cutoff", "before_cutoff", "overall"] and all(r["questions"] == 0 and r["bleu_pp"] == 0 for r in got)


def test_summary_that_exists_is_used(spark):
    a, b = (spark.createDataFrame([(x,)], "n int") for x in (1, 2))
    assert [r["n"] for r in accuracy.or_recomputed(a, b).collect()] == [1]
    assert [r["n"] for r in accuracy.or_recomputed(a.where("false"), b).collect()] == [2]


def _tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_unpack():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/x.tex", "zip")
    assert list(files.unpack(_tar([("a/m.tex", b"one"), ("b.tex", b"two")]))) == [("a/m.tex", "one"), ("b.tex", "two")]
    assert list(files.unpack(z.getvalue())) == [("d/x.tex", "zip")]
    assert list(files.unpack(gzip.compress(b"just"))) == [("extracted.tex", "just")]
    assert list(files.unpack(b"\\documentclass{a}")) == [("raw.tex", "\\documentclass{a}")]
    assert list(files.unpack(b"PK broken")) == [] and list(files.unpack(b"")) == [] and list(files.unpack(b"\x1f\x8bno")) == []


def test_main_file_by_name_marker_and_size(spark):
    m = spark.createDataFrame([("p", 1, "p/z.tex", "x" * 9), ("p", 2, "p/Paper.tex", "y"), ("q", 3, "q/a.tex", "long text"), ("q", 4, "q/b.tex", "\\begin{document}"), ("r", 5, "r/a.tex", "s"), ("r", 6, "r/b.tex", "longer")], "id string, n int, path string, content string")
    assert {(r["id"], r["n"]) for r in files.main_files(m, "id", "n").collect()} == {("p", 2), ("q", 4), ("r", 6)}


def test_include_order_with_a_cycle(spark):
    edges = spark.createDataFrame([("m", "a", 0), ("m", "b", 1), ("a", "c", 0), ("c", "m", 0), ("b", "c", 0)], "source string, target string, position int")
    got = files.include_order(edges, spark.createDataFrame([("m",)], "root string")).orderBy("place").collect()
    assert [r["path"] for r in got] == ["m", "a", "c", "b"]


def test_include_order_of_a_long_chain_and_of_unreferenced_files(spark):
    """No depth is too deep, a later but smaller place wins, and files that nothing includes come last, by path."""
    edges = [(f"f{i:02d}", f"f{i + 1:02d}", 0) for i in range(36)] + [("f00", "f20", 1), ("f36", "f00", 0), ("lost", "f01", 0)]
    every = [("f00", f"f{i:02d}") for i in range(37)] + [("f00", "lost"), ("f00", "also lost"), ("f00", "lost")]
    got = files.include_order(spark.createDataFrame(edges, "source string, target string, position int"), spark.createDataFrame([("f00",)], "root string"), spark.createDataFrame(every, "root string, path string"))
    assert [r["path"] for r in got.orderBy("place").collect()] == [f"f{i:02d}" for i in range(37)] + ["also lost", "lost"]


def test_include_order_is_the_depth_first_walk(spark):
    """Random graphs against a walk with a visited set."""
    import random

    def walk(after, at, seen):
        seen.append(at)
        for x in after[at]:
            if x not in seen:
                walk(after, x, seen)
        return seen

    draw = random.Random(5)
    graphs = [{n: draw.sample(range(9), draw.randint(0, 3)) for n in range(9)} for _ in range(20)]
    edges = [(100 * g + n, 100 * g + x, i) for g, after in enumerate(graphs) for n in after for i, x in enumerate(after[n])]
    got = files.include_order(spark.createDataFrame(edges, "source int, target int, position int"), spark.createDataFrame([(100 * g,) for g in range(20)], "root int")).orderBy("root", "place").collect()
    assert [(r["root"], r["path"]) for r in got] == [(100 * g, 100 * g + x) for g, after in enumerate(graphs) for x in walk(after, 0, [])]


def test_file_order_follows_the_texts(spark):
    rows = [("p", "main.tex", r"\include{b} \input{parts/a} \input{gone}"), ("p", "parts/a.tex", r"\input{c.tex}"), ("p", "parts/c.tex", "x"), ("p", "c.tex", "x"), ("p", "sub/b.tex", r"\input{main}"), ("p", "aside.tex", "x"), ("q", "only.tex", r"\input{c}")]
    got = files.file_order(spark.createDataFrame(rows, "paper string, path string, content string")).orderBy("paper", "place").collect()
    assert [r["path"] for r in got] == ["main.tex", "parts/a.tex", "parts/c.tex", "sub/b.tex", "aside.tex", "c.tex", "only.tex"]


def test_dynamic_overwrite_keeps_other_partitions(spark):
    path = new_table_path(spark, "dyn")
    files.save(spark.createDataFrame([(1, "a"), (2, "b")], "n int, p string"), path, by=["p"])
    files.save(spark.createDataFrame([(3, "a")], "n int, p string"), path, by=["p"])
    assert sorted(r["n"] for r in spark.read.parquet(path).collect()) == [2, 3]
    assert files.count_or_zero(spark, path) == 2 and files.count_or_zero(spark, path + "-none") == 0


def test_json_sinks(spark):
    path = new_table_path(spark, "metrics")
    files.save_metrics(spark.createDataFrame([("m", 0.5)], "model string, accuracy double"), path, "run1", context="without")
    files.save_metrics(spark.createDataFrame([("m", 0.6)], "model string, accuracy double"), path, "run2", context="with")
    assert {(r["run"], r["context"]) for r in spark.read.json(path).collect()} == {("run1", "without"), ("run2", "with")}


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.read_json(spark, str(tmp_path), "a int").count() == 2


def test_failed_replies_follow_the_rule(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    told = spark.createDataFrame([("a", '{"v": "true"}'), ("b", "broken")], "x string, response string").select(F.sha2("x", 256).alias("prompt_key"), "response")
    got = stages.replies(df, F.col("x"), told, ["v"], "v string")
    assert {r["x"] for r in stages.keep_judged(got, F.col("reply.v"), "true", keep_failed=True).collect()} == {"b", "c"}
    assert {r["x"] for r in stages.keep_judged(got, F.col("reply.v"), "false", keep_failed=False).collect()} == {"a"}


def test_call_asks_again_for_what_failed(spark):
    def model(prompts):
        return [None if p == "bad" else p.upper() for p in prompts]

    got = stages.call(spark.createDataFrame([("x",), ("x",), ("bad",)], "p string"), F.col("p"), model).collect()
    assert sorted(str(r["response"]) for r in got) == ["None", "X"]


def test_prompts_asked_in_parallel(spark):
    def ask(p):
        if p == "bad":
            raise RuntimeError
        return p + "!"

    got = stages.call(spark.createDataFrame([(f"p{i}",) for i in range(20)] + [("bad",)], "p string"), F.col("p"), stages.in_parallel(ask, 8), tries=2).collect()
    assert len(got) == 21 and sum(r["response"] is None for r in got) == 1


def test_compiling_follows_the_compiler(spark, tmp_path):
    fake = tmp_path / "tex"
    fake.write_text("#!/bin/sh\ngrep -q bad x.tex && exit 1 || exit 0\n")
    fake.chmod(0o755)
    df = spark.createDataFrame([("good",), ("bad",), (None,)], "t string")
    assert [r["compiles"] for r in stages.compiles(df, "t", compiler=str(fake)).collect()] == [True, False, None]
    assert [r["compiles"] for r in stages.compiles(df, "t", compiler="no-such-compiler").collect()] == [None] * 3


def test_code_must_be_allowed(spark):
    df = spark.createDataFrame([("print(int(input()) + 1)", [("1", "2"), ("1", "3")])], "code string, cases array<struct<input:string,output:string>>")
    with pytest.raises(PermissionError):
        stages.execute(df, "code", "cases")
    assert stages.execute(df, "code", "cases", allow_untrusted=True).first()["results"] == ["PASS", "FAIL"]
    assert stages.run_code("while True: pass", "", 0.5)[0] == "TIMEOUT" and stages.run_code("1/0", "")[0] == "ERROR"


def test_stream_remembers_across_runs(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in ([("a",), ("b",), ("a",)], [("b",), ("c",), (None,)]):
        spark.createDataFrame(part, "id string").write.mode("append").parquet(src)
        incremental.unseen(incremental.stream_of(spark, src, "id string", 1), "id", lambda b: b, out, ck)
    assert sorted(r["id"] for r in spark.read.parquet(out + "/rows").collect()) == ["a", "b", "c"]


def test_shared_dir_is_the_sessions():
    """A cluster's folder is used; only without one is there one of our own."""
    from types import SimpleNamespace

    given = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "file:///tmp/given/"))
    assert shared_dir(given) == "file:///tmp/given"


def test_materialised_tables_are_in_the_shared_dir(spark):
    assert new_table_path(spark, "x").startswith(shared_dir(spark) + "/marlstone/x-")


def test_only_small_dimensions_are_broadcast(spark, monkeypatch):
    """By rows and by bytes."""

    def hinted(df):
        return "broadcast" in rows.dimension(df)._jdf.queryExecution().analyzed().toString().lower() or "strategy=broadcast" in rows.dimension(df)._jdf.queryExecution().logical().toString().lower()

    wide = spark.range(50).selectExpr("id", "repeat('x', 1000) as t")
    assert hinted(wide)
    monkeypatch.setattr(rows, "DIMENSION_BYTES", 10_000)
    assert not hinted(wide)
    monkeypatch.setattr(rows, "DIMENSION_BYTES", 16 << 20)
    monkeypatch.setattr(rows, "DIMENSION_ROWS", 49)
    assert not hinted(wide)


def test_a_shared_folder_is_asked_for():
    """Outside a single machine there is none of our own."""
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda k, d=None: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(far)
