"""Subject areas of documents: curated terms, a multi-pattern automaton and calibrated thresholds.

Method. ``subject_terms.tsv`` holds curated, weighted terms by subject and language. One
automaton finds all of them in one pass over a text; of overlapping finds the
longest counts. A term weighs its curated weight (1 a word; half of that where it has an
everyday sense or one in several subjects), shared among the subjects it
stands for, times its rarity over all documents (see ``rarity_of``).
A sentence is about the subject whose terms weigh most in
it, if they weigh at least that subject's threshold; terms inside a remark in
passing (cue words, see CUES) count a tenth. A document has each subject that
``share`` of its sentences or more are about, which normalizes by length.

The thresholds are calibrated on the labels: all labelled documents choose
among THRESHOLDS for each subject, counted by subject and threshold without
bringing rows to the driver. Rarity is counted over all documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words
from marlstone.session import materialise

TERMS = Path(__file__).with_name("subject_terms.tsv")
#: Cues of a remark in passing, in four languages.
CUES = ("by the way", "footnote", "of all things", "one might say", "in passing", "incidentally", "mentions", "nebenbei", "übrigens", "fußnote", "beiläufig", "au passage", "soit dit en passant", "note de bas de page", "por cierto", "dicho sea de paso", "nota al pie")
CUE_FACTOR = 0.1
THRESHOLDS = (0.2, 0.3, 0.4, 0.55, 0.7, 0.85)
DEFAULT_THRESHOLD = 0.4
#: Labelled documents from which on a subject has a threshold of its own.
LEAST_LABELS = 20

_TAG = re.compile(r"<[^<>]{1,80}>")
_BROKEN = re.compile(r"[ÂÃ][\u0080-ɏ–-™]")
_HYPHEN = re.compile(r"(?<=\w)[-­]\r?\n(?=\w)")
_SPACE = re.compile(r"[\s*]+")
_END = re.compile(r"[.!?…][\"')\]]*(?=\s|$)")
_LETTERS = re.compile(r"[^\W\d_]{2,}")


def lexicon(path: str | Path = TERMS) -> tuple[list[str], list[tuple[str, dict[int, float]]]]:
    """(subjects, [(term, its weight for each subject it stands for)]). A weight is the one given in the list, or 1, times the words; a term of several subjects is shared among them."""
    subjects: list[str] = []
    stands: dict[str, dict[int, float]] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if not line or line.startswith("#"):
            continue
        subject, _, terms = line.split("\t")
        if subject not in subjects:
            subjects.append(subject)
        for term in terms.split(";"):
            word, _, weight = term.strip().partition("=")
            own = stands.setdefault(unicodedata.normalize("NFC", word.lower()), {})
            own[subjects.index(subject)] = max(own.get(subjects.index(subject), 0.0), float(weight or 1) * len(word.split()))
    return subjects, [(t, {s: w / len(own) for s, w in own.items()}) for t, own in sorted(stands.items())]


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def clean(text: str) -> str:
    """Lower-cased text on one line: markup gone, twice-encoded characters and line-end hyphens mended."""
    text = html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text
    if "Ã" in text or "Â" in text:
        text = _BROKEN.sub(_repair, text)
    text = _HYPHEN.sub("", text)
    return _SPACE.sub(" ", unicodedata.normalize("NFC", text)).lower()


def _automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word(t, (i, len(t)))
        if t[-1:].isalpha() and not t.endswith("s"):
            a.add_word(t + "s", (i, len(t) + 1))
    for cue in CUES:
        a.add_word(cue, (-1, len(cue)))
    a.make_automaton()
    return a


def find_terms(text: str, automaton) -> tuple[int, list[int], list[int], list[bool]]:
    """(sentences, and of each term found: its sentence, its number, whether it stands in a remark in passing)."""
    text = clean(text)
    n = len(text)
    found, cues = [], []
    for end, (term, length) in automaton.iter(text):
        a, b = end - length + 1, end + 1
        if (a and text[a - 1].isalnum()) or (b < n and text[b].isalnum()):
            continue
        (cues if term < 0 else found).append((a, b, term))
    found.sort(key=lambda x: (x[0], -x[1]))
    kept, last = [], 0
    for a, b, term in found:
        if b > last:
            kept.append((a, term))
            last = b
    bounds, at = [], 0
    for m in _END.finditer(text):
        bounds.append((at, m.end(), True))
        at = m.end()
    if at < n:
        bounds.append((at, n, False))
    sentences, terms, passing, k, c, count = [], [], [], 0, 0, 0
    cues.sort()
    for a, b, ended in bounds:
        first = k
        while k < len(kept) and kept[k][0] < b:
            k += 1
        has_cue = False
        while c < len(cues) and cues[c][0] < b:
            has_cue = True
            c += 1
        # what lacks a final stop or has hardly a word is a heading, a header line or code
        if k > first or (ended and len(_LETTERS.findall(text, a, b)) >= 3):
            for _, term in kept[first:k]:
                sentences.append(count)
                terms.append(term)
                passing.append(has_cue)
            count += 1
    return count, sentences, terms, passing


FINDS = "doc_id bigint, sentences int, sentence array<int>, term array<int>, passing array<boolean>"


def _find(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(terms)
        for batch in words.bounded(batches, 1):
            got = [find_terms(t, automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.int32()), *(pa.array([g[i] for g in got], pa.list_(kind)) for i, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.bool_())))],
                names=["doc_id", "sentences", "sentence", "term", "passing"],
            )

    return run


def _score(shares: list[dict[int, float]], n_subjects: int, rarity: np.ndarray, thresholds: np.ndarray):
    """Per document, subject and row of ``thresholds`` (a value per subject): the number of sentences about the subject."""
    share = np.zeros((len(shares), n_subjects))
    for i, own in enumerate(shares):
        for s, weight in own.items():
            share[i, s] = weight * rarity[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, total = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            terms = batch.column(3).flatten().to_numpy()
            if not len(terms):
                continue
            doc = np.repeat(np.arange(len(ids)), pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))
            start = np.concatenate(([0], np.cumsum(total)))
            at = start[doc] + batch.column(2).flatten().to_numpy()
            factor = np.where(batch.column(4).flatten().to_numpy(zero_copy_only=False), CUE_FACTOR, 1.0)
            score = np.zeros((int(start[-1]), n_subjects))
            np.add.at(score, at, share[terms] * factor[:, None])
            top = score.max(axis=1)
            where = np.repeat(np.arange(len(ids)), total)
            for k, least in enumerate(thresholds):
                about = (score >= top[:, None] - 1e-9) & (score >= least[None, :])
                count = np.zeros((len(ids), n_subjects), np.int64)
                np.add.at(count, where, about)
                d, s = np.nonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[d]), pa.array(s.astype(np.int32)), pa.array(np.full(len(d), k, np.int32)), pa.array(count[d, s].astype(np.int32)), pa.array(total[d].astype(np.int32))],
                    names=["doc_id", "subject_no", "threshold_no", "about", "sentences"],
                )

    return run


SCORES = "doc_id bigint, subject_no int, threshold_no int, about int, sentences int"


def subject_shares(
    docs: DataFrame, labels: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", share: float = 0.25, max_labels: int | None = None, terms_path: str | Path = TERMS,
) -> DataFrame:
    """(doc_id, subject, about, sentences): every subject of every document.

    ``labels`` (doc_id, subject, ...) calibrate the evidence threshold, all of them
    unless ``max_labels`` bounds the documents, in id order; labels of
    unknown subjects or documents, and repeated ones, do no harm; without labels the
    default holds. Null keys and null or empty texts have no subject. A key given more
    than once is one document if its texts agree (its counts are the largest of each).
    A sentence in which several subjects weigh the same counts for each of them.
    """
    spark = docs.sparkSession
    subjects, stands = lexicon(terms_path)
    terms = [t for t, _ in stands]
    finds = materialise(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_find(terms), FINDS), "finds")
    counts = finds.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").count().collect()  # a row per term of the list
    n = finds.count()
    df = np.zeros(len(terms))
    for r in counts:
        df[r["term"]] = r["count"]
    where = [own for _, own in stands]
    rarity = rarity_of(df, n)
    least = np.full(len(subjects), DEFAULT_THRESHOLD)
    if labels is not None:
        least = _calibrated(finds, labels, subjects, where, rarity, share, max_labels)
    names = F.element_at(F.array(*[F.lit(s) for s in subjects]), F.col("subject_no") + 1)
    return (
        finds.mapInArrow(_score(where, len(subjects), rarity, least[None, :]), SCORES)
        .where(F.col("about") >= share * F.col("sentences"))
        .groupBy("doc_id", names.alias("subject"))
        .agg(F.max("about").alias("about"), F.max("sentences").alias("sentences"))
    )


def rarity_of(documents: np.ndarray, n: int) -> np.ndarray:
    """How rare each term is: the root of its inverse document frequency over the mean of those found. No bound; a term that no document has counts as the rarest found."""
    idf = np.log((n + 1) / (np.maximum(documents, 1) + 1))
    mean = idf[documents > 0].mean() if (documents > 0).any() else 0.0
    return np.sqrt(np.maximum(idf, 0) / mean) if mean > 0 else np.ones(len(documents))


def _calibrated(finds: DataFrame, labels: DataFrame, subjects: list[str], where: list[dict[int, float]], rarity: np.ndarray, share: float, max_labels: int | None = None) -> np.ndarray:
    """A threshold per subject: the one with the best agreement (F1 over documents) with the labels most labellers gave.

    Of a document's subjects those with the most votes count, all of them where several have as many.
    Votes are of distinct labellers. All labelled documents count, or the first ``max_labels`` where that is given, each with all its labels.
    Of thresholds that agree as well, and for subjects with fewer than LEAST_LABELS documents, the one that
    is best for all subjects together counts.
    """
    votes = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).select("doc_id", "subject", *([F.col("labeller")] if "labeller" in labels.columns else [F.lit("").alias("labeller")])).distinct()
    counted = votes.groupBy("doc_id", "subject").agg(F.count("*").alias("votes"))
    labelled = counted.groupBy("doc_id").agg(F.max("votes").alias("votes"))
    if max_labels is not None:
        labelled = labelled.orderBy("doc_id").limit(max_labels)
    number = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (s, i)]), F.col("subject"))
    kept = materialise(counted.join(labelled, ["doc_id", "votes"]).select("doc_id", number.cast("int").alias("subject_no")), "labels")
    n = len(subjects)
    told = np.zeros(n, np.int64)
    for r in kept.groupBy("subject_no").count().collect():  # a row per subject
        told[r["subject_no"]] = r["count"]
    least = np.full(n, DEFAULT_THRESHOLD)
    if not told.any():
        return least
    own = finds.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    tried = np.repeat(np.array(THRESHOLDS)[:, None], n, axis=1)
    rows = own.mapInArrow(_score(where, n, rarity, tried), SCORES).where(F.col("about") >= share * F.col("sentences")).select("doc_id", "subject_no", "threshold_no").distinct()
    mine, right = np.zeros((len(THRESHOLDS), n), np.int64), np.zeros((len(THRESHOLDS), n), np.int64)
    counts = rows.join(kept.withColumn("told", F.lit(1)), ["doc_id", "subject_no"], "left").groupBy("threshold_no", "subject_no").agg(F.count("*").alias("mine"), F.count("told").alias("right"))
    for r in counts.collect():  # a row per threshold and subject
        mine[r["threshold_no"], r["subject_no"]], right[r["threshold_no"], r["subject_no"]] = r["mine"], r["right"]

    def agreement(k: int, only: int | slice = slice(None)) -> float:
        return 2 * int(right[k, only].sum()) / max(1, int(mine[k, only].sum() + told[only].sum()))

    order = range(len(THRESHOLDS))
    best = max(order, key=lambda k: (round(agreement(k), 9), -abs(THRESHOLDS[k] - DEFAULT_THRESHOLD), k))
    for i in range(n):
        enough = told[i] >= LEAST_LABELS
        least[i] = THRESHOLDS[max(order, key=lambda k: (round(agreement(k, i), 9), k == best, -abs(THRESHOLDS[k] - THRESHOLDS[best])))] if enough else THRESHOLDS[best]
    return least


def composition(docs: DataFrame, shares: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(subject, documents, permille): how many documents each subject has; a document with several counts for each, ``none`` for those without."""
    ids = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id")).distinct()
    total = ids.agg(F.count("*").alias("total"))
    by = ids.join(shares.select("doc_id", "subject"), "doc_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count("*").alias("documents"))
    return by.crossJoin(total).select("subject", "documents", F.round(F.col("documents") * 1000 / F.col("total"), 1).alias("permille"))  # total is one row
