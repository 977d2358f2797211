"""Broken prompt and response pairs: each defective pair with its kind of defect.

Method. Copies: the response's words are aligned with the prompt's, by the share of
its two-word shingles that the prompt contains and by the longest common subsequence.
Refusals: each clause of the response is aligned with refusal templates,
again by longest common subsequence. Truncation: what lacks a final stop is complete
if its tail (last word, or last word and value) is one that ends sentences: of all
places where the tail stands in the distinct responses, a share is before a final
stop. A share does not move with the size of the column. Language: function words and
script, of worded responses only. Defects are looked for in the order of DEFECTS and
the first one found is given.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.resources
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import refusals, words
from marlstone.session import materialise

DEFECTS = ("empty_answer", "copies_question", "refusal", "other_language", "truncated_answer")

#: Stand-ins for no value.
NO_VALUE = {"none", "null", "nil", "nan", "na", "n a", "undefined", "tbd", "todo", "empty", "no answer", "unknown", "missing"}
#: Words and signs that cannot end a sentence.
OPEN_ENDS = set("the a an of to for with by and or that which because is are has have be equals equal exactly in on from as than such then therefore hence so if when while der die das und ist ein eine von mit für dass weil den dem le la les et est des du de un une que qui pour par el los las y es del en e di il".split())

#: Scripts by code points, and the languages of the list that are written in them.
SCRIPTS = (("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))
WRITTEN_IN = {"greek": ("el",), "cyrillic": ("ru", "uk", "bg"), "latin": ("vi",)}
_OTHER_SCRIPTS = {l for script, languages in WRITTEN_IN.items() if script != "latin" for l in languages}

_MATH = re.compile(r"\$[^$]*\$")
_OPEN_MATH = re.compile(r"\$[^$]*(?:\$|$)")
_WORDS = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_ELIDED = re.compile(r"[^\W\d_]+'?")
_LEAD = re.compile(r"^(?:\W*\w+){1,5}\W*:\s+(.+)", re.DOTALL)
_SENTENCE = re.compile(r"[.!?;:](?=\s)")
_MARKUP = re.compile(r"\\[a-z]+\s*(?:\{\s*\})+|<[^<>]*>|&[a-z]+;")
_CUT = re.compile(r"(?:\.\.\.+|…|\[(?:cut|truncated|\.\.\.|…)\]|[-–—,:;(\[{\\])\s*$")
_STOP = re.compile(r"[.!?。！？][\"'”’)\]]*\s*$")
_TOKEN = re.compile(r"\x01|\d(?:[\d.,/]*\d)?|[^\W\d_]+(?:[-'’][^\W\d_]+)*|[.!?。！？]")
_STOPS = frozenset(".!?。！？")


@functools.cache
def function_words() -> dict[str, list[str]]:
    """The languages that each word is a function word of; the list may lie in the archive that Spark handed out."""
    out: dict[str, list[str]] = {}
    for line in importlib.resources.files(__package__).joinpath("function_words.tsv").read_text(encoding="utf-8").splitlines():
        if line and not line.startswith("#"):
            language, words_ = line.split("\t")
            for w in set(words_.split()):
                out.setdefault(w, []).append(language)
    return out


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence; bit-parallel, so a text of n words costs n steps on integers of len(a) bits."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = _MARKUP.sub(" ", answer)
    # what is left must hold a letter or a digit of any script
    bare = " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text).split()).lower()
    return not bare or bare in NO_VALUE


def copies(question: str, answer: str) -> bool:
    """Whether the answer gives back the question, or its final sentence, perhaps after a short lead that ends in a colon."""
    q = _WORDS.findall(question.lower())
    for text in (answer, *_LEAD.findall(answer)):
        a = _WORDS.findall(text.lower())
        if not a or not q:
            continue
        if len(a) < 5 or len(q) < 5:
            # too short to align: the same words, and more than a number or name
            if len(a) > 1 and a in (q, _WORDS.findall(_SENTENCE.split(question.strip())[-1].lower())):
                return True
            continue
        have = set(q)
        if sum(x in have for x in a) < 0.7 * len(a):
            continue
        pairs = set(zip(q, q[1:]))
        shared = sum(x in pairs for x in zip(a, a[1:])) / (len(a) - 1)
        if shared >= 0.7 or common_subsequence(a, q) >= 0.8 * len(a):
            return True
    return False


def language(text: str) -> tuple[str | None, dict[str, int], int]:
    """(language or None, function words by language, words)."""
    plain = _OPEN_MATH.sub(" ", text)
    scripts: dict[str, int] = {}
    for c in plain:
        if c.isalpha() and ord(c) > 0x24F:
            s = next((name for name, low, high in SCRIPTS if low <= ord(c) <= high), "other")
            scripts[s] = scripts.get(s, 0) + 1
    tokens = _ELIDED.findall(plain.lower().replace("’", "'"))
    known = function_words()
    score: dict[str, int] = {}
    for w in tokens:
        for l in known.get(w) or known.get(w.rstrip("'"), ()):
            score[l] = score.get(l, 0) + 1
    if scripts and sum(scripts.values()) > 0.3 * sum(map(len, tokens)):
        script = max(scripts, key=scripts.get)
        own = {l: n for l, n in score.items() if l in WRITTEN_IN.get(script, ())}
        return (max(own, key=own.get) if own else script), own, len(tokens) + sum(scripts.values())
    score = {l: n for l, n in score.items() if l not in _OTHER_SCRIPTS}
    best = max(score, key=score.get, default=None)
    return (best if best and score[best] >= 2 else None), score, len(tokens)


def other_language(question: str, answer: str) -> bool:
    """A worded answer whose language, by function words or script, is not the question's; more function words of it than of the question's are needed."""
    mine, score, n = language(answer)
    if mine is None or n < 2:
        return False
    asked, _, _ = language(question)
    return asked is not None and mine != asked and score.get(mine, 9) > score.get(asked, 0)


def ending(answer: str) -> tuple[str, str]:
    """('cut' | 'stop' | 'open' | 'bare', tail). ``open`` needs the tail to be known as an end."""
    text = answer.strip()
    if text.count("$") % 2 or text.count("{") > text.count("}"):
        return "cut", ""
    if _CUT.search(text):
        return "cut", ""
    stop = bool(_STOP.search(text))
    masked = _MATH.sub(" \x01 ", _STOP.sub("", text))
    tokens = ["\x01" if t == "\x01" or t[:1].isdigit() else t.lower() for t in re.findall(r"\x01|\d[\d.,/]*|[^\W\d_]+(?:[-'’][^\W\d_]+)*", masked)]
    if len(tokens) <= 2 and not stop:
        return ("open", tokens[-1]) if len(tokens) == 2 and tokens[-1] in OPEN_ENDS else ("bare", "")
    if not tokens:
        return "bare", ""
    tail = " ".join(tokens[-2:]) if tokens[-1] == "\x01" else tokens[-1]
    if not stop and tokens[-1] in OPEN_ENDS:
        # a word such as the German "ist" does end sentences: left to the counts
        return "open", tail
    return ("stop" if stop and len(tokens) > 2 else "bare" if stop else "open"), tail


def occurrences(answer: str) -> tuple[list[str], list[str]]:
    """Tails of an answer, each as often as it stands there: before a final stop, and inside a sentence. An end without a stop is neither."""
    tokens = _TOKEN.findall(_MATH.sub(" \x01 ", answer.strip()))
    ends, inside = [], []
    last = "."
    for token, after in zip(tokens, tokens[1:]):
        if token not in _STOPS:
            value = token == "\x01" or token[:1].isdigit()
            token = "\x01" if value else token.lower()
            tail = f"{last} \x01" if value and last not in _STOPS else token
            (ends if after in _STOPS else inside).append(tail)
        last = token
    return ends, inside


def judge(question: str | None, answer: str | None) -> tuple[str | None, str | None, str | None]:
    """(defect, ending, tail); the defect of an open end is decided from the counts of tails."""
    if is_empty(answer):
        return "empty_answer", None, None
    if question and copies(question, answer):
        return "copies_question", None, None
    if refusals.refuses(_MATH.sub(" ", answer)):
        return "refusal", None, None
    if question and other_language(question, answer):
        return "other_language", None, None
    kind, tail = ending(answer)
    return ("truncated_answer" if kind == "cut" else None), kind, tail


JUDGED = "qa_id bigint, defect string, ending string, tail string, answer_key string, ends array<string>, inside array<string>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
    for batch in words.bounded(batches, 2):
        got = []
        for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            defect, kind, tail = judge(q, a)
            # only answers without a defect tell where tails stand; answers that differ in case or white space are the same
            same = None if defect else hashlib.blake2b(" ".join(a.lower().split()).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            got.append((defect, kind, tail, same, *((None, None) if defect else occurrences(a))))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], names=["qa_id", "defect", "ending", "tail", "answer_key", "ends", "inside"])


def defective_pairs(df: DataFrame, *, key: str = "qa_id", question: str = "question", answer: str = "answer", least_share: float = 0.1) -> DataFrame:
    """(key, defect): one row per defective pair.

    A null or blank answer is ``empty_answer``, whatever the question; a null question
    leaves only copies and languages unchecked. Null keys are left out. A key given
    more than once is one pair (with differing contents, the defect that comes first in
    DEFECTS). ``least_share``: of a tail's places in the distinct answers without another
    defect, the share before a final stop that makes it an end; one without any is none.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("qa_id"), question, answer)
    judged = materialise(rows.mapInArrow(_judge, JUDGED), "judged")
    told = judged.where("defect is null").select("answer_key", "ends", "inside").dropDuplicates(["answer_key"])
    places = told.select(F.explode("ends").alias("tail"), F.lit(1).alias("end")).unionByName(told.select(F.explode("inside").alias("tail"), F.lit(0).alias("end")))
    ends = places.groupBy("tail").agg(F.avg("end").alias("share")).where((F.col("share") > 0) & (F.col("share") >= least_share))
    unknown = judged.where("ending = 'open'").join(ends, "tail", "left_anti").select("qa_id", F.lit("truncated_answer").alias("defect"))
    order = F.array_position(F.array(*[F.lit(x) for x in DEFECTS]), F.col("defect"))
    return judged.where("defect is not null").select("qa_id", "defect").unionByName(unknown).groupBy("qa_id").agg(F.min_by("defect", order).alias("defect")).withColumnRenamed("qa_id", key)
