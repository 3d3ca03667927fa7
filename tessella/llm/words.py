"""Vectorised word spans and rolling hashes over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of ``[^\x20\x09-\x0D]+``: every byte but ASCII white space.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z: digits, letters, all beyond ASCII.
ITEM_WORDS = np.zeros(256, dtype=bool)
ITEM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STRIDE = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them; kept for later calls up to 4 M."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 18), base, dtype=np.uint64)
        steps[0] = 1
        found = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _powers[int(base)] = found
    return found


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``most`` bytes of one text column; a longer text comes alone."""
    for batch in batches:
        sizes = _lengths(batch.column(batch.schema.get_field_index(column)))
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(size)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


class Words:
    """Spans of the words of some texts: ``start``, ``end`` in ``data``; ``first[i]`` is text i's first word."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool = False) -> None:
        data, offsets = utf8(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = kind[self.data]
        bound = np.zeros(n + 1, dtype=bool)
        bound[offsets] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | bound[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | bound[1:n]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes. Sums run over some words at a time, so that they stay in the processor's cache."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            low = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, low + _STRIDE, side="right")))
            start, end = self.start[i:j] - low, self.end[i:j] - low
            n = int(end[-1])
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data[low : low + n].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:n], out=total[1:])
            out[i:j] = (total[end] - total[start]) * _power(_BASE_INVERSE, n + 1)[start]
            i = j
        return mix64(out)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries (order counts); len(h) - k + 1 of them, ignoring the texts' bounds."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += h[j : len(h) - k + 1 + j]
    return mix64(total)


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where k-grams that stay in one text begin, as word numbers; and how many each text has."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return np.repeat(first[:-1], counts) + ranges(counts), counts


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def order_by(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices that put rows in the order of ``group`` (whole numbers from 0) and then of ``h``; one sort of 64-bit keys where possible."""
    bits = np.uint64(max(1, int(group.max(initial=0)).bit_length()))
    order = np.argsort(group.astype(np.uint64) << (np.uint64(64) - bits) | h >> bits)
    g, x = group[order], h[order]
    # the key lacks the last bits of h: rows that only those tell apart may stand in the wrong order
    return np.lexsort((h, group)) if ((x[1:] < x[:-1]) & (g[1:] == g[:-1])).any() else order


def segments_of(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of hashes: those that hashes in order fall into, and where each begins."""
    at = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(h) else np.zeros(0, np.int64)
    return at[first], first


MOST_TASKS = 20_000


def tasks_for(least: int, ranges: int) -> int:
    """How many tasks take so many ranges (or buckets) of some MB each: one a range, until a task has to take several, one after the other."""
    return max(least, min(ranges, MOST_TASKS))


def six_bytes(h: np.ndarray) -> np.ndarray:
    """The first 48 bits of each hash, a row of bytes each."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]


def of_six_bytes(data: bytes, n: int, at: int = 0) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    whole[:, 2:] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(-1, 6)
    return whole.view("<u8").ravel()


def window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """The position of the smallest of each w consecutive values, the rightmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(h))
    best, where, width = h, at, 1
    while width < w:
        step = min(width, w - width)
        left, right = best[: len(best) - step], best[step:]
        later = right <= left
        best, where = np.where(later, right, left), np.where(later, where[step:], where[: len(where) - step])
        width += step
    return where[:n]
