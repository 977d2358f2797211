"""Evaluation items inside a training corpus: spaced-seed hashing with verified overlaps.

Method. A spaced seed is a fixed mask over a window of words: its kept positions
are hashed, the others may differ. All windows of the items are hashed under all
masks; document windows are hashed alike and joined to them. A shared hash fixes
an alignment of document and item; around it the aligned words are compared, and
the overlap is extended over substituted words as long as enough words agree. It
is reported with its longest unbroken run, so exact leaks and reworded ones are
told apart. A run of ``SPAN`` equal words is hit by every mask, so none is missed.

Items of at most ``block_bytes`` of text (counted first) go to every task, and documents
are not shuffled. More items are joined by hash: a bit filter of fixed size, made of
the items' hashes, thins the documents' windows before they are shuffled, and the
texts of pairs that share a hash are brought together to be compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words
from marlstone.session import materialise, whole_words

SPAN = 12
#: Kept positions of each mask; the first and last are kept. Chosen by a greedy search: of 20 words with
#: 4 substituted they hit 99 in 100, of 15 words with 3 substituted 92 in 100, and every text with one at each n-th word from n = 4.
MASKS = ("111000101011", "100110110011", "100101001111", "111011000101", "100011111011")
_TABLE_BITS = 22
#: The filter for many items has 2 ** FILTER_BITS bits.
FILTER_BITS = 26
#: Shared hashes looked at together.
HITS_AT_ONCE = 1 << 20


def _window_hashes(w: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's kept words for the window at each position but the last SPAN - 1."""
    m = max(0, len(w) - SPAN + 1)
    h = np.full(m, len(mask), np.uint64)
    with np.errstate(over="ignore"):
        for i, kept in enumerate(mask):
            if kept == "1":
                h = (h ^ w[i : i + m]) * np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(32)
    return h


def _windows(w: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of all windows that lie in one text, for each mask."""
    row = words.rows_of(at)
    for k, mask in enumerate(MASKS):
        h = _window_hashes(w, mask)
        ok = np.flatnonzero(row[: len(h)] == row[SPAN - 1 : SPAN - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
        yield words.mix(h[ok] + np.uint64(k)), ok


class _Items:
    """The items' words and window hashes, ready for lookups."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.words, self.at = words.word_hashes(pa.array(texts, pa.string()))
        hashes, where = zip(*_windows(self.words, self.at))
        self.hash, self.where = np.concatenate(hashes), np.concatenate(where)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.where = self.hash[order], self.where[order]
        self.row = words.rows_of(self.at)
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[(self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True


def _overlap(equal: np.ndarray, at: int, tolerance: int) -> tuple[int, int, int, int]:
    """(from, to, agreeing words, longest run) of the overlap around ``at``: it may cross up to ``tolerance`` differing words in a row."""
    hits = np.flatnonzero(equal)
    k = int(np.searchsorted(hits, at))
    if k == len(hits) or hits[k] != at:
        k = max(0, k - 1)
    broken = np.flatnonzero(np.diff(hits) > tolerance + 1)
    lo = int(broken[broken < k].max()) + 1 if (broken < k).any() else 0
    hi = int(broken[broken >= k].min()) if (broken >= k).any() else len(hits) - 1
    part = hits[lo : hi + 1]
    run_heads = np.flatnonzero(np.concatenate(([True], np.diff(part) > 1)))
    longest = int(np.diff(np.append(run_heads, len(part))).max())
    return int(part[0]), int(part[-1]) + 1, len(part), longest


class _Rule:
    """What makes an overlap a leak."""

    def __init__(self, tolerance: int, least_words: int, least_share: float):
        self.tolerance, self.least_words, self.least_share = tolerance, least_words, least_share

    def best(self, dw: np.ndarray, ew: np.ndarray, hits: Iterable[tuple[int, int]]) -> tuple[int, ...] | None:
        """(longest run, agreeing words, words, place in the document, place in the item) of the best overlap around ``hits``: (distance of the places, place in the document), ascending."""
        best, done, last = None, -1, None
        for shift, place in hits:
            if shift == last and place < done:
                continue
            lo, hi = max(0, shift), min(len(dw), len(ew) + shift)
            if not lo <= place < hi:
                continue
            equal = dw[lo:hi] == ew[lo - shift : hi - shift]
            if not equal[place - lo]:
                continue
            a, b, agree, longest = _overlap(equal, place - lo, self.tolerance)
            last, done = shift, lo + b
            if longest >= SPAN or (agree >= self.least_words and agree >= self.least_share * (b - a)):
                new = (longest, agree, b - a, lo + a, lo + a - shift)
                best = new if best is None else max(best, new)
        return best


LEAKS = "doc_id bigint, item_id bigint, longest_run int, agreeing_words int, overlap_words int, doc_word int, item_word int"
_NAMES = ["doc_id", "item_id", "longest_run", "agreeing_words", "overlap_words", "doc_word", "item_word"]


def _rows(docs, items, best: list[tuple[int, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), *(pa.array([v[i] for v in best], pa.int32()) for i in range(5))], names=_NAMES)


def _groups(hits: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Rows (document, item, shift, place) by document and item."""
    hits = np.unique(hits, axis=0)
    heads = np.flatnonzero(np.concatenate(([True], (hits[1:, :2] != hits[:-1, :2]).any(axis=1))))
    for a, b in zip(heads, np.append(heads[1:], len(hits))):
        yield int(hits[a, 0]), int(hits[a, 1]), hits[a:b, 2:].tolist()


def _finder(ids: list[int], texts: list[str], rule: _Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(ids, texts)
        for batch in words.bounded(batches, 1):
            w, at = words.word_hashes(batch.column(1))
            row = words.rows_of(at)
            places, lefts, counts = [], [], []
            for h, ok in _windows(w, at):
                maybe = items.maybe[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
                h, p = h[maybe], ok[maybe]
                left = np.searchsorted(items.hash, h, "left")
                n = np.searchsorted(items.hash, h, "right") - left
                places.append(p[n > 0])
                lefts.append(left[n > 0])
                counts.append(n[n > 0])
            p, left, n = np.concatenate(places), np.concatenate(lefts), np.concatenate(counts)
            order = np.argsort(p, kind="stable")
            p, left, n = p[order], left[order], n[order]
            best: dict[tuple[int, int], tuple[int, ...]] = {}
            total, begin = np.cumsum(n), 0
            while begin < len(p):
                # a hash that many items share times many windows is not held at once
                stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + HITS_AT_ONCE, side="right")))
                m, l = n[begin:stop], left[begin:stop]
                place = np.repeat(p[begin:stop], m)
                q = items.where[np.repeat(l - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(int(m.sum()))]
                doc, item = row[place], items.row[q]
                own = place - at[doc]
                for d, e, hits in _groups(np.stack((doc, item, own - (q - items.at[item]), own), axis=1)):
                    new = rule.best(w[at[d] : at[d + 1]], items.words[items.at[e] : items.at[e + 1]], hits)
                    if new is not None:
                        best[d, e] = max(new, best.get((d, e), new))
                begin = stop
            if best:
                yield _rows(batch.column(0).take(pa.array([d for d, _ in best])), items.ids[[e for _, e in best]], list(best.values()))

    return run


def _hasher(bits):
    """A mapInArrow function from (key, text) to (hash, key, place) of all windows, or of those whose bit is set in a broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 1):
            w, at = words.word_hashes(batch.column(1))
            row, keys = words.rows_of(at), batch.column(0)
            for h, ok in _windows(w, at):
                if bits is not None:
                    place = h >> np.uint64(64 - FILTER_BITS)
                    maybe = bits.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1
                    h, ok = h[maybe], ok[maybe]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys.take(pa.array(row[ok])), pa.array((ok - at[row[ok]]).astype(np.int32))], names=["hash", "key", "place"])

    return run


def _comparer(rule: _Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 2):
            (w, at), (ew, et) = words.word_hashes(batch.column(2)), words.word_hashes(batch.column(3))
            kept, best = [], []
            for i, hits in enumerate(batch.column(4).to_pylist()):
                new = rule.best(w[at[i] : at[i + 1]], ew[et[i] : et[i + 1]], sorted((h["shift"], h["place"]) for h in hits))
                if new is not None:
                    kept.append(i)
                    best.append(new)
            if kept:
                yield _rows(batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), best)

    return run


def _joined(corpus: DataFrame, known: DataFrame, rule: _Rule) -> DataFrame:
    """Leaks of any number of items, by a join on the windows' hashes."""
    spark = corpus.sparkSession
    windows = materialise(known.mapInArrow(_hasher(None), "hash bigint, key bigint, place int"), "item-windows")
    # one 64-bit word of the filter a row: at most 2 ** (FILTER_BITS - 6) of them
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    told = windows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[told["word"].to_numpy(np.int64)] = told["bits"].to_numpy(np.int64).view(np.uint64)
    shared = corpus.mapInArrow(_hasher(spark.sparkContext.broadcast(bits)), "hash bigint, key bigint, place int").withColumnsRenamed({"key": "k", "place": "at"})
    hits = shared.join(windows.withColumnsRenamed({"key": "i"}), "hash").groupBy("k", "i").agg(F.collect_set(F.struct((F.col("at") - F.col("place")).alias("shift"), F.col("at").alias("place"))).alias("hits"))
    texts = hits.join(corpus, "k").join(known.withColumnRenamed("t", "item"), "i").select("k", "i", "t", "item", "hits")
    found = texts.mapInArrow(_comparer(rule), LEAKS)
    # a key that was given with several texts has one row, that of the best
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*_NAMES[2:])).alias("best")).select("doc_id", "item_id", "best.*")


def leaked_items(
    docs: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "item_text",
    tolerance: int = 2, least_words: int = SPAN, least_share: float = 0.8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, longest_run, agreeing_words, overlap_words, doc_word, item_word): the best overlap of each leaking document and item.

    An overlap crosses at most ``tolerance`` differing words in a row and has a run of SPAN
    equal words, or ``least_words`` agreeing words that are ``least_share`` of it or more. Null keys and null
    texts, and texts of fewer than SPAN words, leak nothing. Documents with equal text
    each have their rows; an item given twice under one id has one row. Extra columns are ignored.
    """
    known = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("i"), whole_words(item_text).alias("t")).distinct()
    corpus = docs.where(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_key).cast("bigint").alias("k"), whole_words(doc_text).alias("t"))
    rule = _Rule(tolerance, least_words, least_share)
    size = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > block_bytes:
        return _joined(corpus, known, rule)
    rows = known.collect()  # no more than block_bytes of text
    return corpus.mapInArrow(_finder([r["i"] for r in rows], [r["t"] for r in rows], rule), LEAKS)
