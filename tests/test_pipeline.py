import pytest
from pyspark.sql import functions as F

from marlstone import commands
from marlstone.__main__ import main
from marlstone.functions import latex, text
from marlstone.plans import pipeline
from marlstone.session import table
from marlstone.sources import fetch, files


def test_limits_are_checked():
    for bad in (dict(year=2024, month=13), dict(year=2024, month=0), dict(year=2024, month=1, categories=("a",), subcategories=("b",)), dict(year=2024, month=1, quota=0)):
        with pytest.raises(ValueError):
            pipeline.Job(**bad)
    for bad in ((0,), (21,), (3, 4, 2)):
        with pytest.raises(ValueError):
            pipeline.Cloze(*bad)


def test_month_is_built_once(spark, data):
    """Processed papers add nothing, and a category has no more than its quota."""
    p, t = table(spark, data, "papers"), table(spark, data, "latex_text")
    job = pipeline.Job(2024, 2, quota=2)
    first = pipeline.build_month(job, p, t)
    assert all(r["n"] <= 2 for r in first.groupBy("category").agg(F.count("*").alias("n")).collect())
    assert pipeline.build_month(job, p, t, done=p.select("id")).count() == 0
    assert pipeline.build_month(pipeline.Job(2024, 2, categories=("nothing",)), p, t).count() == 0


def test_build_counts_finished_pairs(spark):
    """Comments go first, every stage drops what it should, and the quota counts pairs that are left, by topic and month."""

    def recorded(ask, columns, replies):
        df = spark.createDataFrame(list(replies), columns)
        return df.select(F.sha2(ask, 256).alias("prompt_key"), "response")

    def thm(x):
        return f"\\begin{{theorem}}{x}\\end{{theorem}}\n"

    names = ["unasked", "vague", "unpaired", "poor", "empty", "easy", "g1", "g2", "g3"]
    one = "% \\appendix is not here\n% " + thm("commented") + "".join(map(thm, names)) + "\\appendix\n" + thm("late")
    papers = spark.createDataFrame([("a", "math.NT", 1, 1), ("a", "math.NT", 2, 9), ("b", "math.NT", 2, 2), ("c", "math.AG", 1, 3), (None, "math.NT", 1, 4), ("d", "math.NT", 1, 5)], "id string, category string, batch_no int, paper_row long")
    texts = spark.createDataFrame([("a", 1, one), ("a", 2, thm("g9")), ("b", 3, thm("g1") + thm("g4")), ("c", 4, thm("g5")), ("d", 5, None)], "id string, text_row long, full_text string")
    every = [*names, "commented", "late", *(f"g{i}" for i in range(4, 10))]
    unique = recorded(pipeline.ask_unique(), "content string, response string", [(x, '{"single_unique_answer": "%s"}' % ("False" if x == "vague" else "true")) for x in every if x != "unasked"])
    pair = {x: '{"question": "Q %s", "answer": "%s", "is_good_qa": "%s"}' % (x, "" if x == "empty" else "A", "false" if x == "poor" else "true") for x in every if x != "unpaired"}
    written = recorded(pipeline.ask_pair(), "content string, response string", pair.items())
    first = pipeline.month_statements(papers, texts)
    easy = next(r["context"] for r in first.where("content = 'easy'").collect())
    trivial = recorded(pipeline.ask_trivial(), "context string, question string, answer string, response string", [(easy, "Q easy", "A", '{"is_trivial": "true"}')])

    def built(**job):
        got = pipeline.build_pairs(papers, texts, unique, written, trivial, **job).orderBy("month", "topic", "paper_id", "start").collect()
        return [(r["month"], r["topic"], r["paper_id"], r["content"]) for r in got]

    a = [("2023-07", "math.NT", "a", x) for x in ("g1", "g2", "g3")]
    b, c = [("2023-08", "math.NT", "b", x) for x in ("g1", "g4")], ("2023-07", "math.AG", "c", "g5")
    assert built() == [c, *a, *b]
    # six statements that fail come before these two
    assert built(job=pipeline.Job(2023, 7, subcategories=("math.NT",), quota=2)) == a[:2]
    assert built(job=pipeline.Job(2023, 7, categories=("math",), quota=9)) == [(m, "math", p, x) for m, _, p, x in (*a, c)]
    assert built(done=papers.where("id = 'a'").select("id")) == [c, *b]


def test_fetch_gives_up_softly(spark):
    def get(url):
        if "bad" in url:
            raise OSError
        return url.encode()

    df = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "u string")
    got = {r["url"]: bytes(r["content"]) for r in fetch.fetch(df, "u", get, tries=2, first_wait=0, courtesy=0).collect()}
    assert got == {"a": b"a", "bad": b""}


def test_command_line(spark, data, tmp_path, capsys):
    main(["list"])
    assert "cutoff_gap\t" in capsys.readouterr().out
    main(["run", "partition_counts", "--data", data, "--out", str(tmp_path / "o")])
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    with pytest.raises(SystemExit):
        main(["run", "partition_counts"])


def test_commands_from_papers_to_counts(spark, data, tmp_path, capsys):
    """build, collate and count after each other, a second build adding nothing; evaluate; a log that is written also after an error."""
    at = lambda name: str(tmp_path / name)
    found = pipeline.month_statements(table(spark, data, "papers"), table(spark, data, "latex_text"))
    key = lambda ask: F.sha2(ask, 256).alias("prompt_key")
    found.select(key(pipeline.ask_unique()), F.lit('{"single_unique_answer": "true"}').alias("response")).write.parquet(at("r/unique.parquet"))
    pair = F.to_json(F.struct(F.concat(F.lit("Q "), F.col("content")).alias("question"), F.lit("A").alias("answer"), F.lit("true").alias("is_good_qa")))
    found.select(key(pipeline.ask_pair()), pair.alias("response")).write.parquet(at("r/written.parquet"))
    spark.createDataFrame([], "prompt_key string, response string").write.parquet(at("r/trivial.parquet"))
    ask = ["--log", at("log.txt"), "build", "--data", data, "--responses", at("r"), "--out", at("pairs")]
    main(ask)
    n = spark.read.parquet(at("pairs")).count()
    assert n > 0 and "build is done" in (tmp_path / "log.txt").read_text()
    main(ask)
    assert spark.read.parquet(at("pairs")).count() == n
    main(["collate", "--root", at("pairs"), "--out", at("all")])
    main(["collate", "--root", at("pairs"), "--out", at("all")])
    one = spark.read.parquet(at("all"))
    assert one.count() == spark.read.parquet(at("pairs")).select("context").distinct().count()
    capsys.readouterr()
    main(["count", "--root", at("all"), "--limit", "20", "--tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"])
    assert "over_limit" in capsys.readouterr().out
    total = {t: commands.count(spark, at("all"), t, 20).where("month is null").first() for t in ("words", "estimate")}
    assert all(r["pairs"] == one.count() and r["over_limit"] > 0 for r in total.values())
    main(["evaluate", "--results", f"{data}/eval_results.parquet", "--by", "model,paper_domain"])
    assert "accuracy" in capsys.readouterr().out
    with pytest.raises(Exception):
        main(["--log", at("bad.txt"), "count", "--root", at("none")])
    assert "ended by" in (tmp_path / "bad.txt").read_text()


def test_cloze_command(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    items = spark.createDataFrame([("l1", "T1", "2024-01-02", "some text"), ("l2", "T2", "2024-01-03", "other text")], "link string, title string, date string, section string")
    items.write.parquet(at("items"))
    asked = items.select("title", F.sha2(text.prompt(commands.ASK_CLOZE, title=F.col("title"), section=F.col("section")), 256).alias("prompt_key"))
    replies = [("T1", 1, "nothing"), ("T1", 2, '{"question": "a [blank1]", "answer1": " two words"}'), ("T2", 1, '{"question": "b", "answer1": "two"}'), ("T2", 4, '{"question": "a [blank1]", "answer1": "late"}')]
    asked.join(spark.createDataFrame(replies, "title string, attempt int, response string"), "title").select("prompt_key", "attempt", "response").write.parquet(at("attempts"))
    main(["cloze", "--items", at("items"), "--attempts", at("attempts"), "--out", at("out"), "--blanks", "1", "--models", '{"m": {"api": "x", "cutoff": "2024-01-01"}}'])
    got = {r["link"]: (r["cloze_question"], r["answer1"], r["error"]) for r in spark.read.parquet(at("out")).collect()}
    assert got == {"l1": ("a [blank1]", "two words", None), "l2": ("ERROR", "ERROR", "All retries failed")}
    for bad in (["--blanks", "21"], ["--min-words", "3", "--max-words", "2"], ["--models", '{"m": {"api": "x"}}']):
        with pytest.raises(ValueError):
            main(["cloze", "--items", at("items"), "--attempts", at("attempts"), "--out", at("out"), *bad])
    with pytest.raises(ValueError):
        main(["build", "--data", "d", "--responses", "r", "--out", "o", "--year", "2024", "--month", "13"])


def test_replacing_and_checking_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 3):
        files.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n and files.is_dataset(spark, path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    assert not files.is_dataset(spark, path + "-none") and not files.is_dataset(spark, path + "-none", every=False)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text("{broken")
    assert files.load_problems(spark, str(tmp_path / "b")).count() == 1  # a file that is there is loaded, not replaced by the sample


def test_large_archives_are_cut(spark, monkeypatch):
    members = spark.createDataFrame([(f"{i}.tex", "x" * 100) for i in range(40)], "member string, content string").coalesce(1)
    monkeypatch.setattr(files, "ARCHIVE_BYTES", 500)
    packed = files.pack(members)
    assert files.archive_members(packed).select("member", "content").exceptAll(members).count() == 0


def test_numbers_of_statements(spark):
    """Told nearby, by section and counter, or by the counter alone; declared names are shown."""
    far = "x" * 1100 + "\n"
    body = "\\begin{thm}one\\end{thm}" + far + "\\begin{thm}[7]given\\end{thm}" + far + "\\section{A}" + far + "\\begin{thm}two\\end{thm}" + far + "\\begin{theorem}three\\end{theorem}"
    head = "\\newtheorem{thm}{Main Theorem}\n"
    by = "\\numberwithin{thm}{section}\n"
    rows = [(1, head + far + body), (2, by + head + far + body)]
    t = spark.createDataFrame(rows, "k int, t string").select("k", "t", latex.statements(F.col("t")).alias("all"), F.when(latex.numbered_by_section(F.col("t")), latex.sections(F.col("t"))).alias("sections"))
    each = t.select("*", F.explode(F.arrays_zip(F.col("all").alias("s"), latex.counters(F.col("all")).alias("counter"))).alias("x"))
    got = each.where("x.s.number is null").select("k", F.concat(latex.display_name(F.col("t"), F.col("x.s.env")), F.lit(" "), latex.plain_number(F.col("t"), F.col("x.s"), F.col("x.counter"), F.col("sections"))).alias("shown"), "x.s.content")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "Main Theorem 1", "one"), (1, "Main Theorem 3", "two"), (1, "Theorem 1", "three"),
        (2, "Main Theorem 1", "one"), (2, "Main Theorem 1.3", "two"), (2, "Theorem 1.1", "three"),
    ]
