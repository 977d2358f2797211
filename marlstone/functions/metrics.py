"""Text similarity metrics as columns; only the stemmed ROUGE-L needs Python."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import text
from marlstone.functions.text import let

#: Weights of 1- to 4-grams, and what a zero count of matches becomes.
BLEU_WEIGHTS = (0.5, 0.3, 0.15, 0.05)
EPSILON = 0.1
#: Thresholds of the binary score.
ROUGE_LEAST, BLEU_LEAST = 0.80, 0.50


def exact_match(ref: Column, hyp: Column) -> Column:
    return text.normalized(ref) == text.normalized(hyp)


def tokens(c: Column) -> Column:
    return text.words(text.normalized(c))


def token_f1(ref: Column, hyp: Column) -> Column:
    """F1 over the sets of words; 1 if both are empty, 0 if one is."""

    def f1(t: Column) -> Column:
        r, h, both = t["r"], t["h"], F.size(F.array_intersect(t["r"], t["h"]))
        return F.when(r == h, 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(r) + F.size(h)))

    return let(F.struct(F.array_distinct(tokens(ref)).alias("r"), F.array_distinct(tokens(hyp)).alias("h")), f1)


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays: rows of the dynamic programme folded over ``a``.

    Costs the product of the lengths: meant for answers, not for documents. The arrays
    should be cheap to evaluate (columns, or bound by ``let``).
    """

    def row(prev: Column, x: Column) -> Column:
        # prev[j]: best for the first j elements of b; the new row grows from the left
        steps = F.arrays_zip(b.alias("y"), F.slice(prev, 1, F.size(b)).alias("diagonal"), F.slice(prev, 2, F.size(b)).alias("above"))
        return F.aggregate(steps, F.array(F.lit(0)), lambda cur, s: F.concat(cur, F.array(F.when(s["y"] == x, s["diagonal"] + 1).otherwise(F.greatest(s["above"], F.element_at(cur, -1))))))

    table = F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1)

    # up to 62 elements of b are the bits of one number, and a row is a few integer operations (Hyyro 2004)
    one = F.lit(1).cast("bigint")
    full = F.call_function("shiftleft", one, F.size(b)) - one

    def bits(v: Column, x: Column) -> Column:
        where = F.aggregate(F.transform(b, lambda y, i: F.when(y == x, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda p, q: p.bitwiseOR(q))
        return let(v.bitwiseAND(where), lambda u: (v + u).bitwiseOR(v - u).bitwiseAND(full))

    short = F.size(b) - F.bit_count(F.aggregate(a, full, bits))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.size(b) <= 62, short).otherwise(table)


def rouge_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def rouge_l_plain(ref: Column, hyp: Column) -> Column:
    """ROUGE-L F-measure without stemming."""

    def score(t: Column) -> Column:
        unlike = let(lcs_length(t["r"], t["h"]), lambda n: F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(t["r"]) + F.size(t["h"]))))
        return F.when(t["r"] == t["h"], F.when(F.size(t["r"]) > 0, 1.0).otherwise(0.0)).otherwise(unlike)

    return let(F.struct(rouge_tokens(ref).alias("r"), rouge_tokens(hyp).alias("h")), score)


_VOWEL = "aeiou"
#: Suffixes of the stemmer's steps 2 to 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in _VOWEL or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def porter_stem(w: str) -> str:
    """Porter's stemmer (1980), for lower-case words."""
    if len(w) <= 2:
        return w

    def ends_double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"

    def cvc(s: str) -> bool:
        return len(s) > 2 and _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    # step 1a and 1b
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = 2 if w.endswith("ed") and "v" in _shape(w[:-2]) else 3 if w.endswith("ing") and "v" in _shape(w[:-3]) else 0
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif ends_double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + table[suffix]
                break
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    # step 5
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _rouge(ref: str | None, hyp: str | None) -> float:
    def cut(s: str | None) -> list[str]:
        return [porter_stem(t) if len(t) > 3 else t for t in re.findall("[a-z0-9]+", (s or "").lower())]

    a, b = cut(ref), cut(hyp)
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """ROUGE-L F-measure of Porter stems."""
    return pd.Series([_rouge(a, b) for a, b in zip(ref, hyp)], dtype="float64")


def _grams(t: Column, n: int) -> Column:
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), "\x02"))).otherwise(F.array().cast("array<string>"))


def _clipped(rg: Column, hg: Column) -> Column:
    return F.aggregate(F.array_distinct(F.array_intersect(hg, rg)), F.lit(0), lambda acc, g: acc + F.least(F.size(F.filter(hg, lambda x: x == g)), F.size(F.filter(rg, lambda x: x == g))))


def bleu(ref: Column, hyp: Column) -> Column:
    """Sentence BLEU of up to 4-grams; n-grams without a match count as EPSILON, no word in common gives 0."""

    def weighted(t: Column, n: int, weight: float) -> Column:
        def log_precision(g: Column) -> Column:
            return let(_clipped(g["r"], g["h"]), lambda c: weight * F.log(F.when(c == 0, F.lit(EPSILON)).otherwise(c.cast("double")) / F.greatest(F.size(g["h"]), F.lit(1))))

        return let(F.struct(_grams(t["r"], n).alias("r"), _grams(t["h"], n).alias("h")), log_precision)

    def score(t: Column) -> Column:
        r, h = t["r"], t["h"]
        brevity = F.when(F.size(h) > F.size(r), 0.0).otherwise(1 - F.size(r) / F.greatest(F.size(h), F.lit(1)))
        total = brevity
        for n, weight in enumerate(BLEU_WEIGHTS, 1):
            total = total + weighted(t, n, weight)
        # of equal texts every n-gram matches, as far as there are any
        whole = sum((F.when(F.size(h) >= n, 0.0).otherwise(weight * math.log(EPSILON)) for n, weight in enumerate(BLEU_WEIGHTS, 1)), F.lit(0.0))
        return F.when(~F.arrays_overlap(r, h), 0.0).when(r == h, F.exp(whole)).otherwise(F.exp(total))

    return let(F.struct(tokens(ref).alias("r"), tokens(hyp).alias("h")), score)


def binary_correct(em: Column, rouge: Column, bleu_: Column) -> Column:
    return em | ((rouge >= ROUGE_LEAST) & (bleu_ >= BLEU_LEAST))


def bleu_of(ref: list[str], hyp: list[str]) -> float:
    """The same for two word lists, in Python: what tests compare with."""
    if not set(ref) & set(hyp):
        return 0.0
    total = 0.0
    for n, weight in enumerate(BLEU_WEIGHTS, 1):
        rg, hg = [[tuple(t[i : i + n]) for i in range(len(t) - n + 1)] for t in (ref, hyp)]
        got = sum(min(hg.count(g), rg.count(g)) for g in set(hg))
        total += weight * math.log((got or EPSILON) / max(1, len(hg)))
    return math.exp(total + (0.0 if len(hyp) > len(ref) else 1 - len(ref) / max(1, len(hyp))))
