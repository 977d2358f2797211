"""Splitting, leaks, subjects, broken pairs, samples and mixtures."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import leaks, mixing, pairs_quality, sampling, splitting, subjects


def check_pieces(text, pieces, most, overlap):
    end = 0
    for i, (a, b, kind) in enumerate(pieces):
        assert b - a <= most and (a == end - overlap if i else a == 0) and (b > end or not text)
        if kind in ("sentence", "paragraph", "line", "space"):
            assert text[b : b + 1].isspace() or text[b - 1] in "。！？"
        end = b
    assert end == len(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n\té́中。", max_size=400), st.integers(2, 60), st.integers(0, 20))
def test_pieces_of_any_text(text, most, overlap):
    if overlap < most:
        check_pieces(text, splitting.cut(text, most, overlap), most, overlap)


def test_topic_change_is_the_cut():
    one = "Whales swim through deep oceans. Oceans shelter whales and dolphins. Dolphins follow whales across oceans. " * 3
    two = "Parliament passed taxation statutes. Statutes bind parliament ministers. Ministers defend taxation statutes. " * 3
    text = one + two
    (_, end, kind), *_ = splitting.cut(text, len(one) + 90, 20)
    assert abs(end - len(one)) <= 1 and kind == "sentence"


def test_split_edge_rows(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (None, "x"), (3, "x" * 25), (4, "short"), (4, "short"), (5, "word " * 50_000)], "piece long, boundary string")
    got = splitting.split_texts(df, "piece", "boundary", 10, 3).collect()
    by = collections.Counter(r["row_key"] for r in got)
    assert by[1] == 1 and by[4] == 2 and 2 not in by and None not in by and by[3] == 4 and by[5] > 20_000
    assert all(r["no_boundary"] for r in got if r["row_key"] == 3)
    assert splitting.split_texts(df.limit(0), "piece", "boundary", 10, 3).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, "piece", "boundary", 10, 10)


def test_leaks_whole_part_and_reworded(spark):
    item = "the quick brown fox jumps over a lazy dog while seven old wizards mix strange potions under the pale moon tonight"
    w = item.split()
    texts = {
        1: "Before. " + item.upper().replace(" ", " - ") + ". After.",
        2: "x " + " ".join(w[3:15]) + " y",  # 12 words
        3: "x " + " ".join(w[3:14]) + " y",  # 11 words
        4: " ".join(x if i % 9 != 6 else "other" for i, x in enumerate(w)),  # substitutions
        5: "nothing of the kind", 6: "", 7: None,
    }
    docs = spark.createDataFrame([(k, t, k) for k, t in texts.items()] + [(None, item, 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, item), (10, item), (11, "too short"), (12, None), (None, item)], "item_id bigint, item_text string")
    got = {r["doc_id"]: r for r in leaks.leaked_items(docs, items).collect()}
    assert {k for k, r in got.items() if r["longest_run"] >= 12} == {1, 2}
    assert got[4]["agreeing_words"] > 12 and got[4]["longest_run"] < 12 and 3 not in got
    assert got[1]["doc_word"] == 1 and got[1]["agreeing_words"] == len(w)
    # more items than a block holds are joined by hash and give the same
    again = leaks.leaked_items(docs, items, block_bytes=60).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.values()))
    assert leaks.leaked_items(docs.limit(0), items).count() == 0 and leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_subjects_by_sentences(spark):
    texts = {
        1: "The plaintiff sued. The jury heard the plaintiff. The tribunal met. A pulsar orbits a quasar.",  # a quarter is enough
        2: "The plaintiff sued. The jury heard them. The tribunal met. The appeal failed. A pulsar near the quasar.",
        3: "The plaintiff sued the defendant. By the way, someone mentions a pulsar.",
        4: "user1 wrote:\nDie Arbeit behandelt LichtkurvÃ¤ und Kometen. Exopla-\nneten sind Planeten bei Pulsaren, nicht Kometen.",
        5: "", 6: None, 7: "Scan 1 of 2, left blank on purpose.", 8: "A latent kernel was censored. The kernel is bayesian.",
    }
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(None, "a plaintiff and a jury.", "x"), (1, texts[1], "x")], "doc_id bigint, text string, sentences string")
    got = collections.defaultdict(set)
    for r in subjects.subject_shares(docs).collect():
        got[r["doc_id"]].add(r["subject"])
    assert got == {1: {"law", "astronomy"}, 2: {"law"}, 3: {"law"}, 4: {"astronomy"}, 8: {"statistics"}}
    made = {r["subject"]: r["documents"] for r in subjects.composition(docs, subjects.subject_shares(docs)).collect()}
    assert made == {"law": 3, "astronomy": 2, "statistics": 1, "none": 3}
    assert subjects.subject_shares(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, "law", "a"), (1, "law", "a"), (99, "law", None), (2, "no such", "b"), (None, "law", "b")], "doc_id bigint, subject string, labeller string")
    assert subjects.subject_shares(docs, labels).count() == 6 and subjects.subject_shares(docs, labels.limit(0)).count() == 6


def test_calibration_follows_most_labellers(spark):
    """A minority's label does not count, and the bound is on documents, not on labels."""
    finds = spark.createDataFrame([(1, 1, [0], [0], [False]), (2, 1, [0], [1], [False]), (3, 2, [0, 1], [2, 1], [False] * 2)], subjects.FINDS)

    def least(labels, most=9):
        return subjects._calibrated(finds, spark.createDataFrame(labels, "doc_id bigint, subject string, labeller string"), ["a", "b"], [{0: 1.0}, {0: 1.0}, {1: 1.0}], np.array([0.6, 0.8, 0.6]), 0.25, most).tolist()

    assert least([(1, "b", "x"), (1, "b", "y"), (1, "a", "z"), (2, "a", "x")]) == [0.7, 0.7]
    for first, last in ("ab", "ba"):
        assert least([(3, first, "x"), (3, last, "x"), (4, "a", "x")], most=1) == [subjects.DEFAULT_THRESHOLD] * 2


def test_a_threshold_for_each_subject(spark):
    """With enough labels of it, a subject has its own; a minority of weak finds is right for one and wrong for the other."""
    finds = spark.createDataFrame([(i, 1, [0], [0 if i < 30 else 1], [False]) for i in range(60)] + [(100 + i, 1, [0], [2], [False]) for i in range(60)], subjects.FINDS)
    labels = spark.createDataFrame([(i, "a", "x") for i in range(60)] + [(100 + i, "b" if i < 30 else "a", "x") for i in range(60)], "doc_id bigint, subject string, labeller string")
    where = [{0: 0.35}, {0: 0.9}, {1: 0.35}]
    got = subjects._calibrated(finds, labels, ["a", "b"], where, np.ones(3), 0.25, 500)
    assert got[0] <= 0.3 and got[1] <= 0.3
    labels = labels.selectExpr("doc_id", "if(doc_id < 30, 'b', subject) as subject", "labeller")
    got = subjects._calibrated(finds, labels, ["a", "b"], where, np.ones(3), 0.25, 500)
    assert got[0] >= 0.4 and got[1] <= 0.3


def test_all_labelled_documents_count(spark):
    """More labelled documents than any bound: the later ones, which are most, tell against a low threshold."""
    finds = spark.range(5000).selectExpr("id as doc_id", "1 as sentences", "array(0) as sentence", "array(0) as term", "array(false) as passing").unionByName(
        spark.range(5000, 25_000).selectExpr("id as doc_id", "1 as sentences", "array(0) as sentence", "array(if(id % 4 > 0, 0, 1)) as term", "array(false) as passing")
    )
    labels = spark.range(25_000).selectExpr("id as doc_id", "if(id < 5000 or id % 4 = 0, 'a', 'b') as subject", "'x' as labeller")
    where, seen = [{0: 0.35}, {0: 0.9}], []
    assert subjects._calibrated(finds, labels, ["a", "b"], where, np.ones(2), 0.25)[0] >= 0.4
    assert subjects._calibrated(finds, labels, ["a", "b"], where, np.ones(2), 0.25, 5000)[0] <= 0.3
    original = subjects._calibrated
    with pytest.MonkeyPatch.context() as m:
        m.setattr(subjects, "_calibrated", lambda *a: seen.append(a[6]) or original(*a))
        subjects.subject_shares(spark.createDataFrame([(1, "The plaintiff sued.")], "doc_id bigint, text string"), labels.limit(3))
    assert seen == [None]


def test_rarity_has_no_bound():
    r = subjects.rarity_of(np.array([0, 1, 10, 1000, 100_000]), 100_000)
    assert r[0] == r[1] > r[2] > r[3] > 0.2 and r[4] == 0 and (subjects.rarity_of(np.zeros(3), 5) == 1).all()


def test_terms_have_weights():
    names, terms = subjects.lexicon()
    weight = {t: {names[s]: w for s, w in own.items()} for t, own in terms}
    assert weight["plaintiff"] == {"law": 1.0} and weight["judge"] == {"law": 0.5} and weight["general relativity"] == {"physics": 2.0}
    assert len(weight["kernel"]) == 3 and sum(weight["kernel"].values()) == 0.5


@pytest.mark.parametrize("question, answer, want", [
    ("What is the value of x?", None, "empty_answer"), ("What?", " \xa0\n", "empty_answer"), ("What?", "\\text{}", "empty_answer"), ("What?", "N/A.", "empty_answer"), ("What?", "<p></p>", "empty_answer"), ("What?", "0", None), ("What?", "当", None),
    ("How many tilings of rank five does the board admit?", "We are asked: How many tilings of rank five does the board admit", "copies_question"),
    ("How many tilings of rank five does the board admit?", "The board admits exactly $5$ tilings of that sort.", None),
    ("What is x?", "What is x?", "copies_question"), ("What is x?", "x", None), ("Let n be odd. What is x?", "Question: what is x", "copies_question"), ("What is x?", "What is x? It is $4$.", None),
    ("Q", "I'm sorry, but I can't help with this one.", "refusal"), ("Q", "Diese Frage kann ich leider nicht beantworten.", "refusal"),
    ("Q", "One is unable to do better than $5$, and this value is attained.", None), ("Q", "Sorry-type sequences have length 4.", None), ("Q", "I denotes the identity, and I cannot be replaced: the answer is $4$.", None),
    ("How many of the classes are fixed by the map?", "Es gibt genau 4 solche Klassen, und zwar für die Abbildung.", "other_language"), ("How many?", "Искомое значение равно $4$, так как порядок равен 5.", "other_language"),
    ("How many of the classes are fixed by the map?", "$45$", None), (None, "Es gibt genau 4 solche Klassen, und zwar für die Abbildung.", None),
    ("Q", "The value is equal to $\\frac{4", "truncated_answer"), ("Q", "It follows that the ...", "truncated_answer"), ("Q", "First, it is smooth. Second,", "truncated_answer"),
])
def test_defects(question, answer, want):
    assert pairs_quality.judge(question, answer)[0] == want


def test_refusal_after_a_long_preamble():
    lead = "The question is about tilings. It names a board: a square one. The board has rank five; its sides are even. Much is known of it. "
    assert pairs_quality.judge("Q", lead + "Still, I cannot answer this question.")[0] == "refusal"
    assert pairs_quality.judge("Q", lead + "Their number is $5$.")[0] is None


def test_open_ends_are_counted(spark):
    whole = [(i, "q", f"The order of the group is {i}.") for i in range(5)]
    rows = [*whole, (10, "q", "The order of the group is 7"), (11, "q", "The order of the gro"), (12, None, None), (12, None, None), (None, "q", ""), (13, "q", "The answer is given by the"), (14, "q", "word " * 100_000)]
    got = {r["qa_id"]: r["defect"] for r in pairs_quality.defective_pairs(spark.createDataFrame(rows, "qa_id bigint, question string, answer string").selectExpr("*", "1 as tail", "2 as defect")).collect()}
    assert got == {11: "truncated_answer", 12: "empty_answer", 13: "truncated_answer", 14: "truncated_answer"}
    assert pairs_quality.defective_pairs(spark.createDataFrame([], "qa_id bigint, question string, answer string")).count() == 0


def test_ends_are_a_share_of_distinct_answers(spark):
    """One good end is enough, copies are one answer, and the verdict is the same for ten times the rows."""
    rows = [(1, "q", "These are the classes with $5$."), (2, "q", "All others are those with $7$"), (3, "q", "The cat sat on the mat and the dog sat by the door."), (4, "q", "It follows that we get the")]
    rows += [(10 + i, "q", "We find that it is the.") for i in range(4)] + [(20 + i, "q", "The bound is on the number of the maps of the plane and the line of the form, as the case may be.") for i in range(4)]
    rows += [(30, "q", "The order is the number of the parts of the sum of the rows in the table, as the last of the lines of the proof says.")]

    def cut(times):
        every = [(k + 100 * i, q, a + " " * i) for i in range(times) for k, q, a in rows]
        return {r["qa_id"] % 100 for r in pairs_quality.defective_pairs(spark.createDataFrame(every, "qa_id bigint, question string, answer string")).collect()}

    assert cut(1) == cut(10) == {4}


def test_places_of_tails():
    ends, inside = pairs_quality.occurrences("It is 3.5, say. The order is $x$. Done and")
    assert ends == ["say", "is \x01"] and inside == ["it", "is", "is \x01", "the", "order", "is", "done"]


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert pairs_quality.common_subsequence(a, b) == row[-1]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 40), st.integers(0, 9), st.integers(0, 6)), min_size=1), st.integers(0, 80))
def test_seats_are_the_smallest_priorities(cats, size):
    counts = {c: n for c, (n, _, _) in cats.items()}
    targets = {c: (t, m) for c, (_, t, m) in cats.items()}
    every = [((r > targets[c][1]), ((r - 0.5) / targets[c][0] if targets[c][0] else float("inf")), c) for c, n in counts.items() for r in range(1, n + 1)]
    want = collections.Counter(c for _, _, c in sorted(every)[:size])
    assert {c: s for c, s in sampling.seats(counts, targets, size).items() if s} == dict(want)


def test_sample_edge_rows(spark):
    rows = [(i, " Math.CO" if i % 3 else "cs.lg", "x") for i in range(100)] + [(7, " Math.CO", "x"), (200, None, "x"), (201, "other", "x"), (None, "cs.LG", "x")]
    df = spark.createDataFrame(rows, "qa_id bigint, category string, rank string")
    targets = spark.createDataFrame([("math.CO", 500, 2), ("cs.LG", 400, 3), ("none.X", 100, 1)], "category string, target_permille int, min_rows int")
    s = sampling.ProportionalSample(df, targets)
    assert s.size == 26 and s.rows().count() == 26 and s.rows().select("record_key").distinct().count() == 26
    assert {tuple(r) for r in s.missed().collect()} == {("none.X", "share"), ("none.X", "minimum")}
    # cut into many ranges, the ranks are the same
    kept, sampling.RANGE_ROWS = sampling.RANGE_ROWS, 3
    assert sorted(map(tuple, s.rows().collect())) == sorted(map(tuple, sampling.ProportionalSample(df, targets).rows().collect()))
    sampling.RANGE_ROWS = kept
    assert sorted(r["rank"] for r in s.rows().where("category = 'math.CO'").collect()) == list(range(1, s.seats["math.co"] + 1))
    again = sampling.ProportionalSample(df, targets, seed="other").rows()
    assert again.exceptAll(s.rows()).count() > 0 and again.count() == 26
    none = sampling.ProportionalSample(df.limit(0), targets)
    assert none.rows().count() == 0 and none.size == 0


def test_report_counts_the_sample(spark):
    """What was drawn is counted from the rows, and no miss is told of a sample that is not the planned one."""
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(40)], "qa_id bigint, category string")
    s = sampling.ProportionalSample(df, spark.createDataFrame([("a", 500, 2), ("b", 300, 2), ("c", 200, 1)], "category string, target_permille int, min_rows int"))
    told = {r["category"]: r["drawn"] for r in s.report().collect()}
    assert told == {**collections.Counter(r["category"] for r in s.rows().collect()), "c": 0}
    whole = s.rows
    s.rows = lambda: whole().where("category <> 'a' or rank > 1")
    for made in (s.report, s.missed):
        with pytest.raises(Exception, match="differ in a"):
            made().collect()


def test_cut_poisson_has_the_wanted_mean():
    for most in (1, 2, 4, 9, 1000):
        for rate in (0.0, 0.01, 0.5 * most, 0.99 * most, most, most + 1):
            below = mixing.cut_poisson(rate, most)
            assert abs(sum(1 - x for x in below) - min(rate, most)) < 1e-6 and below == sorted(below)
    assert abs(sum(1 - x for x in mixing.cut_poisson(950, 1000)) - 950) < 1e-6


def test_mixture(spark):
    rows = [(i, "some words of the text here " * (1 + i % 3), " Big " if i % 10 else "small") for i in range(2000)] + [(5000, None, "big"), (5001, "", None), (5002, "word", "unlisted"), (None, "word", "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as tokens", "2 as copies")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets)
    assert sorted(m.short()) == ["absent", "small"]
    r = {x["source"]: x for x in m.report().collect()}
    assert abs(r["big"]["actual_share"] - 0.6) < 0.03 and r["small"]["mixed_tokens"] == 2 * r["small"]["own_tokens"] and r["absent"]["mixed_tokens"] == 0
    mixed = m.rows().collect()
    per = collections.Counter(x["doc_id"] for x in mixed)
    assert max(per[x["doc_id"]] for x in mixed if x["source"] == "big") == 1 and [x["doc_id"] for x in mixed] != sorted(x["doc_id"] for x in mixed)
    assert [tuple(x) for x in mixing.Mixture(docs, targets).rows().collect()] == [tuple(x) for x in mixed]
    empty = mixing.Mixture(docs.limit(0), targets)
    assert empty.rows().count() == 0 and empty.report().count() == 3


def test_falling_short_follows_the_replication(spark):
    """Told from the mixed tokens, so that the replication is part of the plan; the same as by the sizes."""
    docs = spark.createDataFrame([(i, "some words here", "ab"[i % 4 == 0]) for i in range(400)], "doc_id bigint, text string, source string")
    m = mixing.Mixture(docs, spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("c", 0.1, 3), ("d", 0.0, 2)], "source string, target_share double, max_repeats int"))
    found = m.report().where("falls_short").select("source")
    assert sorted(r["source"] for r in found.collect()) == sorted(m.short()) == ["b", "c"]
    assert "xxhash64" in found._jdf.queryExecution().optimizedPlan().toString()
    whole = m.copies
    m.copies = lambda: whole().where("source <> 'b' or doc_id > 0")
    assert [r["source"] for r in m.report().where("falls_short").collect()] == ["c"]


def test_long_text_is_counted_as_a_whole(monkeypatch):
    """Parts end where the pattern cuts, so the tokens are those of the whole text, with and without spaces."""
    import base64

    import tiktoken

    with open(mixing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["token " * 100, "\n\n  don't, 3.14 été\t中文 x" * 30, "antidisestablishmentarianism" * 20, "a1" * 300, " \n" * 200, ""]
    whole = [encode(t) for t in texts]
    monkeypatch.setattr(mixing, "PART", 50)
    for t, w in zip(texts, whole):
        parts = list(mixing.parts_of(t))
        assert "".join(parts) == t and [x for p in parts for x in encode(p)] == w
    assert len(list(mixing.parts_of(texts[1]))) > 5 and len(list(mixing.parts_of(texts[3]))) > 5


def test_copies_of_a_repeated_key(spark):
    """A key given three times is three documents, in the report and in the mixture."""
    docs = spark.createDataFrame([(1, "one two", "a")] * 3 + [(2, "three", "b")] * 30, "doc_id bigint, text string, source string")
    m = mixing.Mixture(docs, spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 1)], "source string, target_share double, max_repeats int"))
    a = m.rows().where("source = 'a'").collect()
    assert len(a) == 6 and {x["copy_no"] for x in a} == {1, 2}
    assert {r["source"]: r["mixed_tokens"] for r in m.report().collect()}["a"] == 2 * m.own["a"]


def test_leaks_by_substitution_rate():
    """Of passages that an exhaustive search accepts, at least nine in ten are hit by a mask, at 5 to 20 % substitutions."""
    rng = np.random.default_rng(5)
    masks = np.array([[c == "1" for c in m] for m in leaks.MASKS])
    for words_, rate in ((15, 0.05), (15, 0.2), (20, 0.1), (20, 0.2), (30, 0.2)):
        bad = np.zeros((3000, words_), bool)
        for r in bad:
            r[rng.choice(np.arange(1, words_ - 1), round(rate * words_), replace=False)] = True
        windows = np.lib.stride_tricks.sliding_window_view(bad, leaks.SPAN, axis=1)
        hit = ~(windows[:, :, None, :] & masks).any(axis=3)
        assert hit.any(axis=(1, 2)).mean() >= 0.9, (words_, rate)
    for n in range(4, 12):  # a substitution at every n-th word
        for first in range(n):
            bad = np.arange(40) % n == first
            windows = np.lib.stride_tricks.sliding_window_view(bad, leaks.SPAN)
            assert (~(windows[:, None, :] & masks).any(axis=2)).any()
