"""Benchmark decontamination by winnowing (operator 3).

Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is ``window`` consecutive
words of a benchmark item; an item of fewer words is one window. A document word inside an occurrence of a
window is hit.

1. Winnowing: of the ``window - gram + 1`` grams of ``gram`` words in each window of an item, the one with the
   smallest hash is a fingerprint. A document keeps the smallest gram of each of its own windows, so any shared
   span of ``window`` words or more yields a shared fingerprint. Items shorter than a window are their own
   fingerprint, by their exact length.
2. Documents' fingerprints are joined with the items': as a map-side lookup while the items' index is below
   ``max_index_rows`` (checked), otherwise as a shuffled join on the fingerprint.
3. Each hit is extended to both sides, word by word, as far as document and item agree. Spans of a window or
   more are hit; comparing words makes the result exact, whatever the hashes.

Both paths of step 2 give the same rows and columns.

Defined cases: a null or empty text has no words; a text of any length is judged whole; a null item text is no item;
repeated items count once by item_id; an item without an id hits words but is left out of the count of items; equal
documents are judged each for itself; no items or no documents give no hits or no rows. Further columns of ``docs`` pass
through, whatever their names, unless they bear one of the result's (n_words, n_hit, items, spans), whose values replace theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import load, materialize
from .columns import Through
from .skew import spread_join
from .words import ITEM_WORDS, Words, gram_hashes, gram_starts, pieces, window_minimum

WINDOW, GRAM = 10, 5
RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<begin:long,end:long>>"


def fingerprints(words: Words, window: int, gram: int, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, word numbers, hashes): the smallest gram of each window; for a shorter length every gram of it."""
    h = words.hashes()
    starts, _ = gram_starts(words.first, window)
    if len(starts):
        grams = gram_hashes(h, gram)
        at = np.unique(window_minimum(grams, window - gram + 1)[starts])
        yield window, at, grams[at]
    for n in lengths:
        at, _ = gram_starts(words.first, n)
        if len(at):
            yield n, at, gram_hashes(h, n)[at]


class Index:
    """Items' words and where each fingerprint lies in them."""

    def __init__(self, ids: list, texts: list, window: int, gram: int) -> None:
        self.window, self.gram, self.ids, self.items = window, gram, ids, []
        words = Words(pa.array(texts, pa.string()), ITEM_WORDS, lower=True)
        self.items = [[words.word(j) for j in range(words.first[i], words.first[i + 1])] for i in range(len(ids))]
        self.lengths = sorted({len(x) for x in self.items if 0 < len(x) < window})
        self.places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        item_of = words.text_of_word()
        for n, at, hashes in fingerprints(words, window, gram, self.lengths):
            for j, x in zip(at.tolist(), hashes.tolist(), strict=True):
                i = int(item_of[j])
                if n == window or n == len(self.items[i]):
                    self.places.setdefault((n, x), []).append((i, j - int(words.first[i])))
        self.sorted = {n: np.sort(np.array([x for m, x in self.places if m == n], np.uint64)) for n in {m for m, _ in self.places}}

    def judge(self, words: Words) -> list[tuple[np.ndarray, set, list]]:
        """For each text with hits: its number, items and merged spans (counted from its first word)."""
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        text_of = None
        for n, at, hashes in fingerprints(words, self.window, self.gram, self.lengths):
            known = self.sorted.get(n)
            if known is None:
                continue
            slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[slot] == hashes
            if text_of is None:
                text_of = words.text_of_word()
            seen: dict[tuple[int, int, int], int] = {}
            for p, x in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
                t = int(text_of[p])
                for item, q in self.places[n, x]:
                    if seen.get((t, item, p - q), -1) > p:
                        continue
                    low, high = self._extend(words, t, p, item, q)
                    seen[t, item, p - q] = max(high, p + 1)
                    if high - low >= n:
                        found.setdefault(t, {}).setdefault(item, []).append((low - int(words.first[t]), high - int(words.first[t])))
        return [(t, set(by), _merged([s for x in by.values() for s in x])) for t, by in found.items()]

    def _extend(self, words: Words, t: int, p: int, item: int, q: int) -> tuple[int, int]:
        own, first, end = self.items[item], int(words.first[t]), int(words.first[t + 1])
        low, i = p, q
        while low > first and i > 0 and words.word(low - 1) == own[i - 1]:
            low, i = low - 1, i - 1
        high, i = p, q
        while high < end and i < len(own) and words.word(high) == own[i]:
            high, i = high + 1, i + 1
        return (low, high) if high > p else (p, p)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _judged(index: Index, texts: pa.Array) -> tuple[list, list, list, list]:
    words = Words(texts, ITEM_WORDS, lower=True)
    n_hit, items, spans = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
    for t, own, merged in index.judge(words):
        n_hit[t] = sum(b - a for a, b in merged)
        items[t] = sorted({index.ids[i] for i in own if index.ids[i] is not None})
        spans[t] = [{"begin": a, "end": b} for a, b in merged]
    return words.counts.tolist(), n_hit, items, spans


def _arrays(columns: tuple[list, list, list, list]) -> list[pa.Array]:
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), span), strict=True)]


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, max_index_rows: int = 200_000, clean_only: bool = False) -> DataFrame:
    """``docs`` without their text, with n_words, n_hit, items and spans; or, with ``clean_only``, just the documents without a hit, text and all."""
    through = Through(docs, text)
    taken = ("n_words", "n_hit", "items", "spans")
    kept = [c for c, given in through.names.items() if given.lower() not in taken or clean_only]
    return through.back(_contamination(through.rows.select(*kept), bench, text, window, gram, max_index_rows, clean_only))


def _contamination(docs: DataFrame, bench: DataFrame, text: str, window: int, gram: int, max_index_rows: int, clean_only: bool) -> DataFrame:
    spark, kept = docs.sparkSession, docs.columns
    bench = bench.where("text is not null").select(F.col("item_id").cast("long"), "text")
    # an item of n words has at most max(1, n - window + 1) fingerprints, and n is at most half its characters
    bound = bench.agg(F.sum(F.greatest(F.lit(1), F.length("text") / 2))).first()[0] or 0
    if bound > max_index_rows:
        return _shuffled(docs, bench, text, window, gram, kept, clean_only)
    rows = bench.collect()
    index = spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows], window, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            columns = _judged(index.value, batch.column(batch.schema.get_field_index(text)))
            if clean_only:
                yield batch.filter(pa.array(np.array(columns[1]) == 0))
            else:
                own = [c for c in batch.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), *_arrays(columns)], [*own, "n_words", "n_hit", "items", "spans"])

    if clean_only:
        return docs.mapInArrow(run, docs.schema)
    return docs.mapInArrow(run, StructType([*(f for f in docs.schema if f.name != text), *StructType.fromDDL(RESULT)]))


MOST_HELD = 64  # indexes of single items that a task keeps at once


def _shuffled(docs: DataFrame, bench: DataFrame, text: str, window: int, gram: int, kept: list[str], clean_only: bool) -> DataFrame:
    """For an index too large to broadcast: fingerprints meet in a join, then texts of the pairs that share one."""
    lengths = [r["n"] for r in bench.select(F.least(F.regexp_count("text", F.lit("[0-9A-Za-z\u0080-\U0010ffff]+")), F.lit(window)).alias("n")).distinct().collect() if 0 < r["n"] < window]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column(1), ITEM_WORDS, lower=True)
            text_of = words.text_of_word()
            for n, at, hashes in fingerprints(words, window, gram, lengths):
                rows = np.unique(np.stack([text_of[at].astype(np.uint64), hashes], 1), axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[:, 0].astype(np.int64))), pa.array(np.full(len(rows), n, np.int32)), pa.array(rows[:, 1].view(np.int64))], ["key", "n", "print"])

    # documents and items meet by their texts, as ids may be null or repeated; columns that pass through travel in one
    own = [c for c in kept if c != text]
    row = F.struct(*(F.col(f"`{c}`") for c in own)) if own else F.lit(True)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(row.alias("row"), F.col(f"`{text}`").alias("raw"), whole.alias("text"), F.md5(whole).alias("key"))
    texts = keyed.select("key", "text")
    named = bench.withColumn("item", F.md5("text"))
    items = named.select("item", F.col("text").alias("item_text")).dropDuplicates(["item"])
    of_items = items.select(F.col("item").alias("key"), F.col("item_text").alias("text")).mapInArrow(prints, "key string, n int, print long").withColumnRenamed("key", "item")
    of_docs = texts.mapInArrow(prints, "key string, n int, print long").distinct()
    pairs = materialize(spread_join(of_docs, of_items, ["n", "print"], ["key"]).select("key", "item").distinct(), "decontamination-pairs")
    some = texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    both = spread_join(pairs.join(some, "key"), items, ["item"], ["key"], counted=pairs)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Index] = {}
        for batch in pieces(batches, "text"):
            out = []
            for key, item, doc, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item not in held:
                    if len(held) >= MOST_HELD:
                        held.clear()
                    held[item] = Index([item], [other], window, gram)
                _, _, _, spans = _judged(held[item], pa.array([doc]))
                out += [(key, item, s["begin"], s["end"]) for s in spans[0]]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "item", "begin", "end"])

    hits = both.select("key", "item", "text", "item_text").mapInArrow(compare, "key string, item string, begin long, end long")
    ids = named.groupBy("item").agg(F.collect_set("item_id").alias("ids"))
    hit = hits.join(ids, "item").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("found"))
    # spans in order: each that begins within or right after the last one lengthens it
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    longer = lambda a, s: F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["begin"].alias("begin"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    merged = F.aggregate("found", none, lambda a, s: F.when(F.coalesce(s["begin"] <= last(a)["end"], F.lit(False)), longer(a, s)).otherwise(F.concat(a, F.array(s))))
    hit = hit.select("key", "items", merged.alias("spans"))
    judged = spread_join(keyed.withColumn("place", F.monotonically_increasing_id()), hit, ["key"], ["place"], "left", counted=keyed.select("key"))
    if clean_only:
        clean = judged.where("spans is null or size(spans) = 0")
        return clean.select(*((F.col("raw") if c == text else F.col("row").getField(c)).alias(c) for c in kept))
    n_words = F.regexp_count("text", F.lit("[0-9A-Za-z\u0080-\U0010ffff]+")).cast("long")
    spans = F.coalesce("spans", none)
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return judged.select(*(F.col("row").getField(c).alias(c) for c in own), n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), spans.alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS win FROM b),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, n WHERE len(w) >= n),
hits AS (SELECT rid, pos, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT rid, pos, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
