"""Substring dedup by super-k-mer partitioning (operator 1).

A window is ``window`` consecutive words of one document. A word is removed when a window that covers it also
starts in a document with a smaller doc_id; windows are judged on the input, not on what is left.

1. In each slice of the input (some MB of texts) windows are sorted and counted at once: all but those of the smallest
   document of each distinct window are duplicates already and go no further. However many copies a group
   has, a slice sends on one of them.
2. A window's minimiser is the smallest hash among its ``gram``-word grams. Consecutive windows with one minimiser
   travel as one packed string, a super-k-mer: their words, joined by one space. The minimiser alone picks the
   bucket, so equal windows meet, while a word is sent about three times and not once for each window.
   Buckets are as many as hold some MB each. A minimiser that would fill a bucket by itself (estimated from every
   ``ESTIMATE``-th document, which only decides where windows meet) is split: its windows go by their second smallest gram too.
3. A bucket unpacks its strings, sorts all windows and finds the smallest document of each. Windows are sorted by
   hash, and the bytes of equal ones are compared, so the result is exact.
4. Ranges of duplicate words are gathered by document, and each text, packed too, is joined with its own.

Defined cases: a null or empty text has no words and keeps none; a text of fewer words than a window has no window; a
text of any length is taken whole;
rows with a null doc_id neither lose words nor cost others theirs; rows with equal doc_ids do not remove each other's
words; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .words import SPACE_WORDS, Words, gram_hashes, gram_starts, mix64, pieces, ranges, tasks_for, utf8, window_minimum

WINDOW, GRAM, SLICE_BYTES, BUCKET_BYTES, PACK_ABOVE, PACK_LEVEL = 13, 3, 3 << 20, 10 << 20, 400, 3
SENT, ESTIMATE, HOT_WINDOWS = 3, 64, 500_000  # how often a word is sent, about; one in so many documents; windows of one minimiser
_KEYS = np.dtype([("doc_id", "<i8"), ("text_hash", "<i8"), ("begin", "<i4"), ("size", "<i4")])
_RANGES = np.dtype([("doc_id", "<i8"), ("text_hash", "<i8"), ("low", "<i4"), ("high", "<i4")])


def single_spaced(column: pa.Array) -> pa.Array:
    """The texts with one space between words and none around them."""
    words = Words(column, SPACE_WORDS)
    keep = SPACE_WORDS[words.data]
    data = np.where(keep, words.data, np.uint8(0x20))
    later = np.ones(len(words.start), bool)
    later[words.first[:-1][words.counts > 0]] = False
    keep[words.start[later] - 1] = True
    _, offsets = utf8(column)
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[keep]))


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes from a[i] on equal those from b[i] on."""
    out = np.ones(len(a), bool)
    step = max(1, (4 << 20) // max(1, int(size.max(initial=1))))
    for i in range(0, len(a), step):
        n = size[i : i + step]
        at = ranges(n)
        differ = data[np.repeat(a[i : i + step], n) + at] != data[np.repeat(b[i : i + step], n) + at]
        out[i : i + step] = np.bincount(np.repeat(np.arange(len(n)), n), differ, len(n)) == 0
    return out


def first_documents(words: Words, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of single-spaced texts, as first words, and the smallest owner (one per text) of each window's words."""
    starts, counts = gram_starts(words.first, window)
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    own = np.repeat(owner, counts)
    h = gram_hashes(words.hashes(), window)[starts]
    order = np.argsort(h)
    sorted_h = h[order]
    new = np.append(True, sorted_h[1:] != sorted_h[:-1])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    head = order[first][run]
    begin, size = words.start[starts], words.end[starts + window - 1] - words.start[starts]
    again = np.flatnonzero(~new)
    same = size[order[again]] == size[head[again]]
    same[same] = equal_spans(words.data, begin[order[again[same]]], begin[head[again[same]]], size[order[again[same]]])
    least = np.minimum.reduceat(own[order], first)[run]
    if not same.all():  # different windows with one hash: tell them apart by their bytes
        for r in np.unique(run[again[~same]]).tolist():
            least_of: dict[bytes, int] = {}
            at = np.flatnonzero(run == r)
            spans = [words.data[begin[w] : begin[w] + size[w]].tobytes() for w in order[at].tolist()]
            for i, s in zip(at.tolist(), spans, strict=True):
                least_of[s] = min(least_of.get(s, int(own[order[i]])), int(own[order[i]]))
            least[at] = [least_of[s] for s in spans]
    out = np.empty(len(starts), np.int64)
    out[order] = least
    return starts, out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run begins: any key differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def word_ranges(windows: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, low, high) of the words that these windows (in order) cover, adjoining ones merged."""
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = _runs(text, windows - np.arange(len(windows)))
    last = np.append(at[1:], len(windows)) - 1
    return text[at], windows[at], windows[last] + window


def minimisers(words: Words, starts: np.ndarray, window: int, gram: int, hot: np.ndarray) -> np.ndarray:
    """The smallest gram of each window; for those in ``hot`` (sorted), mixed with the smallest of its other grams."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    grams = gram_hashes(words.hashes(), gram)
    least = grams[window_minimum(grams, window - gram + 1)[starts]]
    if len(hot):
        at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            own = grams[starts[some][:, None] + np.arange(window - gram + 1)]
            own[own == least[some][:, None]] = np.iinfo(np.uint64).max
            least[some] = mix64(least[some] + mix64(own.min(axis=1)))
    return least


def hot_minimisers(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Minimisers of more than about HOT_WINDOWS windows: at most one for so many windows of the input. Only where windows meet depends on them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            words = Words(single_spaced(batch.column(0)), SPACE_WORDS)
            starts, _ = gram_starts(words.first, window)
            found, n = np.unique(minimisers(words, starts, window, gram, np.zeros(0, np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["minimiser", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(ESTIMATE)) == 0).select("text")
    often = some.mapInArrow(count, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") * ESTIMATE > HOT_WINDOWS)
    return np.sort(np.array([r["minimiser"] for r in often.toLocalIterator()], np.int64).view(np.uint64))


def pack(buckets: int, hot: np.ndarray, window: int, gram: int, batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) of the windows of a batch (doc_id, text_hash, text) that are the first of their slice."""
    doc_id, text_hash = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    words = Words(single_spaced(batch.column(2)), SPACE_WORDS)
    starts, least = first_documents(words, doc_id, window)
    if not len(starts):
        return
    text_of = words.text_of_word()[starts]
    repeated = least < doc_id[text_of]
    texts, low, high = word_ranges(starts[repeated], text_of[repeated], window)
    local = np.empty(len(texts), _RANGES)
    local["doc_id"], local["text_hash"] = doc_id[texts], text_hash[texts]
    local["low"], local["high"] = low - words.first[texts], high - words.first[texts]

    starts, text_of = starts[~repeated], text_of[~repeated]
    minimiser = minimisers(words, starts, window, gram, hot)
    at = _runs(text_of, minimiser, starts - np.arange(len(starts))) if len(starts) else np.zeros(0, np.int64)
    last = np.append(at[1:], len(starts))[: len(at)] - 1
    bucket = (minimiser[at] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at, last, bucket = at[order], last[order], bucket[order]
    keys = np.empty(len(at), _KEYS)
    keys["doc_id"], keys["text_hash"] = doc_id[text_of[at]], text_hash[text_of[at]]
    keys["begin"] = starts[at] - words.first[text_of[at]]
    begin = words.start[starts[at]]
    keys["size"] = words.end[starts[last] + window - 1] - begin
    bounds = np.append(_runs(bucket), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    if len(local) and len(bounds) < 2:
        yield int(text_hash[0]) % buckets, _payload(local, keys, b"")
    carrier = int(text_hash[0]) % max(1, len(bounds) - 1)  # ranges found here already go along with any bucket
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        size = keys["size"][a:b].astype(np.int64)
        data = words.data[np.repeat(begin[a:b], size) + ranges(size)]
        yield int(bucket[a]), _payload(local if i == carrier else local[:0], keys[a:b], data.tobytes())


def _payload(local: np.ndarray, keys: np.ndarray, data: bytes) -> bytes:
    raw = np.array([len(local), len(keys)], "<u4").tobytes() + local.tobytes() + keys.tobytes() + data
    return b"\x01" + zstandard.compress(raw, PACK_LEVEL) if len(raw) > PACK_ABOVE else b"\x00" + raw


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.decompress(payload[1:]) if payload[0] else payload[1:]
    n_local, n_keys = np.frombuffer(raw, "<u4", 2)
    at = 8 + int(n_local) * _RANGES.itemsize
    end = at + int(n_keys) * _KEYS.itemsize
    return np.frombuffer(raw, _RANGES, n_local, 8), np.frombuffer(raw, _KEYS, n_keys, at), raw[end:]


def repeats(payloads: list[bytes], window: int) -> np.ndarray:
    """Ranges of words, from all payloads of one bucket, whose windows start in a smaller document as well."""
    local, keys, data = zip(*map(_unpacked, payloads), strict=True)
    keys, data = np.concatenate(keys), b"".join(data)
    offsets = np.concatenate([[0], np.cumsum(keys["size"], dtype=np.int64)])
    words = Words(pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(data)), SPACE_WORDS)
    starts, least = first_documents(words, keys["doc_id"], window)
    text_of = words.text_of_word()[starts]
    repeated = least < keys["doc_id"][text_of]
    texts, low, high = word_ranges(starts[repeated], text_of[repeated], window)
    out = np.empty(len(texts), _RANGES)
    out["doc_id"], out["text_hash"] = keys["doc_id"][texts], keys["text_hash"][texts]
    shift = keys["begin"][texts] - words.first[texts]
    out["low"], out["high"] = low + shift, high + shift
    return np.concatenate([*local, out])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, low, high: ranges of words (without high) to remove; ``docs`` has doc_id, text_hash and text. Ranges may overlap."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions, -(-SENT * size // BUCKET_BYTES))
    hot = hot_minimisers(docs, window, gram)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            rows = list(pack(buckets, hot, window, gram, batch))
            if rows:
                numbers, payloads = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and held:
                    yield _as_batch(repeats(held, window))
                    held = []
                bucket = b
                held.append(payload.as_py())
        if held:
            yield _as_batch(repeats(held, window))

    sent = docs.where("doc_id is not null").select("doc_id", "text_hash", "text").mapInArrow(send, "bucket int, payload binary")
    met = sent.repartition(tasks_for(partitions, buckets), "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(receive, "doc_id long, text_hash long, low int, high int")


def _as_batch(found: np.ndarray) -> pa.RecordBatch:
    names = list(found.dtype.names)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[n])) for n in names], names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one space) of each document; with ``digest``, its SHA-256."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = repeated_ranges(docs, window, gram).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(PACK_LEVEL)
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([packer.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "text_hash", "packed"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                some, out = batch.slice(begin, 200), []
                for packed, spans in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    words = zstandard.decompress(packed).split()
                    kept = words
                    if spans:
                        stay = np.ones(len(words), bool)
                        for s in spans:
                            stay[s["low"] : s["high"]] = False
                        kept = [words[i] for i in np.flatnonzero(stay)]
                    joined = b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest() if digest else joined.decode()))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept"])

    texts = docs.mapInArrow(squeeze, "doc_id long, text_hash long, packed binary")
    both = texts.join(found, ["doc_id", "text_hash"], "left").select("doc_id", "packed", "spans")
    return both.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, unnest(range(1, len(w) - 11)) AS pos, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) AS h FROM d WHERE len(w) >= 13 AND doc_id IS NOT NULL),
least_of AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + 13)) AS p FROM win JOIN least_of USING (h) WHERE first_doc < doc_id),
by_doc AS (SELECT rid, list(p) AS ps, count(*) AS n_removed FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN by_doc USING (rid)
"""
