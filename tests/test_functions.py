import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import dates, latex, metrics, text, values


def one(spark, column, **row):
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'bigint' if isinstance(row[n], int) else 'array<string>' if isinstance(row[n], list) else 'string'}" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given_, want",
    [
        ("a % note\nb", "a b"),  # the cut takes the line's end with it
        ("50\\% of\n% gone\nx", "50\\% of\nx"),
        ("$a % b$\n", "$a % b$\n"),
        ("x\n\\begin{comment}\nno\n\\end{comment}\ny", "x\n\ny"),
        ("keep \\iffalse no\nno\n\\fi yes", "keep  yes"),
        ("a \\iffalse b \\fi c\nd", "a "),  # the opening is looked at first: the state stays open
        ("", ""),
    ],
)
def test_comment_states(given_, want):
    assert latex._strip(given_, True) == want


def test_comment_text_joins_lines():
    assert latex._strip("a % note\nb", False) == "a \nb"
    assert latex._strip(None, False) is None


def test_sections_with_own_numbers(spark):
    t = "\\section{One}\\section{7. Seven}\\section[s]{Eight}"
    assert [(s["number"], s["title"]) for s in one(spark, latex.sections(F.col("t")), t=t)] == [(1, "One"), (7, "7. Seven"), (8, "Eight")]


def test_statements_and_numbers(spark):
    t = "\\newtheorem{thm}{Theorem}\\begin{thm}[3] A \\label{thm:4.2} \\end{thm} Theorem 9.1 \\begin{theorem}B\\end{theorem}\\begin{lemma}C\\end{lemma}"
    got = one(spark, latex.statements(F.col("t")), t=t)
    assert [(s["env"], s["number"], s["label"], s["content"]) for s in got] == [("thm", "3", "thm:4.2", "A"), ("theorem", None, None, "B")]
    assert t[got[1]["start"] : got[1]["end"]] == "\\begin{theorem}B\\end{theorem}"


def test_spans_of_repeated_matches(spark):
    assert [(s["start"], s["end"]) for s in one(spark, latex.match_spans(F.col("t"), "ab"), t="abxabab")] == [(0, 2), (3, 5), (5, 7)]


@pytest.mark.parametrize("reply, want", [
    ("blank1: x\nblank2: y", ["x", "y"]), ("Blank2: b\nBLANK1: a", ["a", "b"]), ("blank1: a blank2: b", ["a", "b"]), ("blank1: one\ntwo", ["one", "NO_ANSWER"]), ("nothing", ["NO_ANSWER", "NO_ANSWER"]),
])
def test_blanks(spark, reply, want):
    assert one(spark, text.blanks(F.col("r"), 2), r=reply) == want


def test_code_blocks(spark):
    assert one(spark, text.code_block(F.col("r")), r="x\n```python\ndef f(a):\n  pass\n```\n```python\nz```") == "def f(a):\n  pass"
    assert one(spark, text.code_block(F.col("r")), r="```\nq\n```") == "q"
    assert one(spark, text.code_block(F.col("r")), r="  plain ") == "plain"
    assert one(spark, text.function_name(F.col("r")), r="def  go (x)") == "go"


def test_dates(spark):
    assert str(one(spark, dates.parsed_date(F.col("d")), d="2024-02-30x")) == "1900-01-01"
    assert str(one(spark, dates.parsed_date(F.col("d")), d="2024-02-28T01")) == "2024-02-28"
    assert one(spark, dates.month_key(F.col("d")), d="") == "2023-12"


def test_json(spark):
    assert one(spark, F.size(values.test_cases(F.col("s"))), s="[{nope") == 0
    assert one(spark, values.has_keys(F.col("s"), "a", "b"), s='{"a": 1, "b": null}') is False
    assert one(spark, values.has_keys(F.col("s"), "a"), s='{"a": false}') is True


def test_known_stems():
    for word, stem in (("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("happy", "happi"), ("generalization", "gener"), ("controlling", "control"), ("agreed", "agre"), ("sized", "size")):
        assert metrics.porter_stem(word) == stem


WORDS = st.lists(st.sampled_from(["a", "b", "c", "dd", "e"]), max_size=7)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=30, max_size=30))
def test_metrics_against_python(spark, pairs):
    """Subsequence, BLEU and F1 columns against plain programmes; F1 is symmetric and all lie in [0, 1]."""
    df = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in pairs], "r string, h string")
    r, h = F.col("r"), F.col("h")
    got = df.select("r", "h", metrics.bleu(r, h).alias("bleu"), metrics.token_f1(r, h).alias("f1"), metrics.token_f1(h, r).alias("f2"), metrics.rouge_l_plain(r, h).alias("rouge"), metrics.exact_match(r, h).alias("em")).collect()
    for x in got:
        a, b = x["r"].split(), x["h"].split()
        assert math.isclose(x["bleu"], metrics.bleu_of(a, b), abs_tol=1e-9)
        assert math.isclose(x["rouge"], metrics._rouge(x["r"], x["h"]), abs_tol=1e-9)
        assert x["f1"] == x["f2"] and all(0 <= x[c] <= 1 for c in ("bleu", "f1", "rouge"))
        assert not x["em"] or x["f1"] == 1


def test_long_subsequence(spark):
    """Beyond 62 words the table takes over from the bits."""
    a, b = [f"w{i % 7}" for i in range(70)], [f"w{i % 5}" for i in range(90)]
    got = one(spark, metrics.lcs_length(F.col("a"), F.col("b")), a=a, b=b)
    assert math.isclose(2 * got / 160, metrics._rouge(" ".join(a), " ".join(b)))
