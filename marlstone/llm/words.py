"""Vectorised word and shingle hashing over Arrow string columns.

Everything here works on whole Arrow batches with numpy: no Python code runs
per word or per row. A *word* is a maximal run of the characters a-z and 0-9
of the lower-cased text; callers lower-case in the JVM (``F.lower``), so the
bytes seen here already are lower case and every byte of a multi-byte UTF-8
character is a separator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[ord("0") : ord("9") + 1] = True
_BASE = _U(0x9E3779B97F4A7C15 | 1)
#: Bytes of text hashed at once: bounds the temporary arrays at about 12 times this.
CHUNK_BYTES = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], text: int, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes of column ``text``; a longer text stands alone. Bounds what a function holds at once."""
    for batch in batches:
        at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
        row, n = 0, batch.num_rows
        while row < n:
            stop = max(row + 1, min(row + rows, int(np.searchsorted(at, at[row] + size, side="right")) - 1))
            yield batch.slice(row, stop - row)
            row = stop


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def fixed_bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """(rows, width) of a binary column without nulls whose values all have ``width`` bytes."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(c.buffers()[2], np.uint8)[(lo := int(np.frombuffer(c.buffers()[1], np.int32)[c.offset])) : lo + width * len(c)] for c in chunks if len(c)]
    flat = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return flat.reshape(-1, width)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def _words_of(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word count of each text, first and last byte (exclusive) of each word."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _IS_WORD[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    starts[heads] |= inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = at[1:][at[1:] > 0] - 1
    ends[tails] |= inside[tails]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if len(first) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64), first, last
    length = last - first
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        inner = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
        values = (raw[inside].astype(np.uint64) + _U(1)) * powers[inner]
        hashed = mix(np.add.reduceat(values, begin) + length.astype(np.uint64) * _BASE)
    counts = np.searchsorted(first, at[1:]) - np.searchsorted(first, at[:-1])
    return hashed, counts, first, last


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices ``(from_row, to_row, offsets, bytes)`` of about CHUNK_BYTES; a longer text stands alone."""
    at, raw = _buffers(texts)
    n, row = len(at) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop, at[row : stop + 1] - at[row], raw[at[row] : at[stop]]
        row = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of each text's words), over the whole column."""
    hashes, counts = [], []
    for _, _, at, raw in chunks(texts):
        h, c, _, _ = _words_of(at, raw)
        hashes.append(h)
        counts.append(c)
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return flat, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every element of a ragged column."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _offsets(rows: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int64)


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending."""
    rows = rows_of(offsets)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], _offsets(r[keep], len(offsets) - 1)


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's runs of ``k`` words; a row with fewer words has none."""
    n = len(offsets) - 1
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    rows = rows_of(offsets)
    m = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for i in range(1, k):
            h = mix(h * _U(0x100000001B3) + words[i : m + i])
    keep = rows[:m] == rows[k - 1 :]
    h, r = h[keep], rows[:m][keep]
    return distinct(h, _offsets(r, n))


def counted(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bags as sets: the j-th occurrence of a word in its row becomes an element of its own."""
    rows = rows_of(offsets)
    order = np.lexsort((words, rows))
    w, r = words[order], rows[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    run = np.flatnonzero(fresh)
    nth = np.arange(len(w)) - np.repeat(run, np.diff(np.concatenate((run, [len(w)]))))
    with np.errstate(over="ignore"):
        elements = np.where(nth == 0, w, mix(w + nth.astype(np.uint64) * _BASE))
    return elements, offsets


def minhashes(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(rows, len(seeds)) of uint32 minima; rows without values get all ones."""
    n = len(offsets) - 1
    out = np.full((n, len(seeds)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full) == 0:
        return out
    begin = offsets[:-1][full]
    with np.errstate(over="ignore"):
        for j, seed in enumerate(seeds):
            x = (values ^ seed) * _U(0xD6E8FEB86659FD93)
            x ^= x >> _U(32)
            x = (x * _U(0xD6E8FEB86659FD93)) >> _U(32)
            out[full, j] = np.minimum.reduceat(x, begin)
    return out


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed seeds: a counter put through the finaliser."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + _U(salt))
