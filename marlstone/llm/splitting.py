"""Splitting oversized texts at natural boundaries by lexical cohesion.

Method. Around every paragraph and sentence end the words of the block before and of
the block after are compared (cosine of their counts). A low similarity between higher
ones is a valley: the topic changes there. Within each size window the deepest valley
becomes the cut; where the window has no such boundary, its last line end or space
does, and without any the text is cut at the limit. Each further piece starts
``overlap`` characters before the end of the piece before.

Texts within the limit never reach Python. Time and memory are linear in a text's length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words

#: Words compared on either side of a gap.
BLOCK = 24
GAPS_AT_ONCE = 4096
#: Kinds of boundary, the most natural first; ``none`` is a cut inside a stretch without any, ``end`` the text's end.
KINDS = ("paragraph", "sentence", "line", "space", "none", "end")

_PARAGRAPH = re.compile(r"\S(?=[ \t]*(?:\r\n?|\n)[ \t]*(?:\r\n?|\n))")
_SENTENCE = re.compile(r"[.!?…;][\"'”’)\]}$]*(?=[ \t\r\n])|[。！？]")
_LINE = re.compile(r"[^\s](?=[ \t]*[\r\n])")
_GAP = re.compile(r"[^ \t\r\n](?=[ \t\r\n])")
_STRETCH = re.compile(r"[^ \t\r\n]+")
_WORD = re.compile(r"\w{4,}")


def depths(text: str, cuts: np.ndarray) -> np.ndarray:
    """How deep the cohesion valley is at each of the ascending cut positions."""
    if len(cuts) == 0:
        return np.zeros(0)
    ids: dict[str, int] = {}
    spans = [(m.start(), ids.setdefault(m[0].lower(), len(ids))) for m in _WORD.finditer(text)]
    at = np.array([s for s, _ in spans], np.int64)
    word = np.array([w for _, w in spans], np.int32)
    # unequal fillers stand for the words that are missing at either end
    padded = np.concatenate((-1 - np.arange(BLOCK, dtype=np.int32), word, -1000 - np.arange(BLOCK, dtype=np.int32)))
    where = np.searchsorted(at, cuts)
    step = np.arange(BLOCK)
    likeness = np.zeros(len(cuts))
    for i in range(0, len(cuts), GAPS_AT_ONCE):
        w = where[i : i + GAPS_AT_ONCE, None]
        left, right = padded[w + step], padded[w + BLOCK + step]
        dot = (left[:, :, None] == right[:, None, :]).sum(axis=(1, 2))
        a = (left[:, :, None] == left[:, None, :]).sum(axis=(1, 2))
        b = (right[:, :, None] == right[:, None, :]).sum(axis=(1, 2))
        likeness[i : i + GAPS_AT_ONCE] = dot / np.sqrt(a * b)

    def peaks(s: list[float]) -> list[float]:
        top = s[:]
        for i in range(1, len(s)):
            if s[i - 1] >= s[i]:
                top[i] = max(top[i - 1], s[i])
        return top

    s = likeness.tolist()
    return np.array(peaks(s)) + np.array(peaks(s[::-1])[::-1]) - 2 * likeness


def _ends(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)


def cut(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of the pieces of ``text``, in order; lengths and positions are in code points."""
    n = len(text)
    if n <= max_chars:
        return [(0, n, "end")]
    paragraphs, sentences = _ends(_PARAGRAPH, text), _ends(_SENTENCE, text)
    natural = np.union1d(paragraphs, sentences)
    depth = depths(text, natural)
    is_paragraph = np.isin(natural, paragraphs)
    lines, gaps = _ends(_LINE, text), _ends(_GAP, text)
    pieces, end = [], 0
    while True:
        # the first piece must hold the next one's whole overlap
        start, end = (end - overlap, end) if pieces else (0, overlap)
        most = start + max_chars
        if most >= n:
            pieces.append((start, n, "end"))
            return pieces
        # the window: its later half first, so that pieces aren't needlessly many
        for least in (end + (most - end) // 2, end):
            i, j = np.searchsorted(natural, [least, most], side="right")
            if i < j:
                break
        if i < j:
            k = i + int(np.lexsort((natural[i:j], is_paragraph[i:j], depth[i:j]))[-1])
            new, kind = int(natural[k]), "paragraph" if is_paragraph[k] else "sentence"
        else:
            for ends, kind in ((lines, "line"), (gaps, "space")):
                k = int(np.searchsorted(ends, most, side="right")) - 1
                if k >= 0 and ends[k] > end:
                    new = int(ends[k])
                    break
            else:
                new, kind = most, "none"
                while new > end + 1 and most - new < 16 and (unicodedata.combining(text[new]) or text[new] == "‍" or text[new - 1] == "‍"):
                    new -= 1
        pieces.append((start, new, kind))
        end = new


def has_long_stretch(text: str, max_chars: int) -> bool:
    """Whether more than ``max_chars`` characters follow each other without space, tab, line feed or carriage return."""
    return any(m.end() - m.start() > max_chars for m in _STRETCH.finditer(text))


PIECES = "row_key bigint, piece_no int, start_char long, end_char long, boundary string, piece string, over_limit boolean, no_boundary boolean"


def _cutter(max_chars: int, overlap: int):
    schema = pa.schema([("row_key", pa.int64()), ("piece_no", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("boundary", pa.string()), ("piece", pa.string()), ("over_limit", pa.bool_()), ("no_boundary", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.bounded(batches, 1, rows=64, size=1 << 20):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stretch = has_long_stretch(text, max_chars)
                rows += [(key, i, a, b, kind, text[a:b], True, stretch) for i, (a, b, kind) in enumerate(cut(text, max_chars, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def split_texts(df: DataFrame, key: str, text: str, max_chars: int, overlap: int) -> DataFrame:
    """Pieces of every text: (row_key, piece_no, start_char, end_char, boundary, piece, over_limit, no_boundary).

    Pieces have at most ``max_chars`` characters; piece i + 1 starts exactly ``overlap``
    characters before the end of piece i, and together they hold every character. A text
    within the limit is one piece, an empty text one empty piece. Null texts and null keys
    have no pieces. Rows that repeat a key are one text if they agree; otherwise each
    is split. Extra columns are ignored. Raises ValueError unless ``0 <= overlap < max_chars``.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be smaller than the limit")
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("row_key"), F.col(text).alias("piece"))
    long = rows.where(F.length("piece") > max_chars).mapInArrow(_cutter(max_chars, overlap), PIECES)
    short = rows.where(F.length("piece") <= max_chars).select(
        "row_key", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_char"), F.length("piece").cast("bigint").alias("end_char"), F.lit("end").alias("boundary"), "piece", F.lit(False).alias("over_limit"), F.lit(False).alias("no_boundary")
    )
    return long.unionByName(short)
