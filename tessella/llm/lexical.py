"""Ranked lexical search by pipelined term partitioning (operator 11).

Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. With N documents that hold terms, L of their terms,
n of one document's and df documents that hold a term, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), a document has
m = 10 + (90 n N) div L, and an item's score for it is the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, in
whole numbers. Each item gets its ``k`` best documents.

1. Items are dealt to blocks of at most ``most_chars`` characters (or a single item); a block's terms are broadcast. Usually all
   items are one block; each further block is another pass over the documents.
2. Documents are cut into shards of some MB where they lie. Each shard counts the block's terms, compared byte by byte, into
   postings; N, L and df are sums over shards.
3. Terms are divided among owners in the order of their weights, rarest first. A shard's postings go to the owners of their terms,
   as impacts (whole contributions), and tell how much a term can add at most in that shard.
4. For each shard, an item's bundle visits the owners one after the other. At each it is cogrouped with that owner's postings of the
   shard, adds their impacts to its accumulators, a sparse table of documents, and drops those documents that can't get
   among the k best of their shard with all that later owners can add. Contributions are never negative, so the k-th best sum so far
   bounds the k-th best score from below, and nothing that belongs to the result is dropped.
5. The last owner selects each bundle's k best; these meet in two steps, groups of shards first.

No task holds more than a shard's postings and bundles, however common a term is, and shards don't depend on keys, so none is hot.

Defined cases: null or empty texts have no terms and are found by nobody; an item without terms, or one that nobody shares, gives no
rows; each row of the items is an item of its own, whatever its id, each row of the documents a document; of equal scores the
smaller doc_id goes first, null ones last; empty tables give no rows; texts of any length count whole; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, load, materialize
from .words import ITEM_WORDS, Words, pieces, ranges

K, OWNERS, MOST_CHARS, SHARD_BYTES, SHARD_DOCS = 10, 4, 16_000_000, 8 << 20, 1 << 16
SLICE = "shard long, doc_ids array<long>, n array<long>, term array<int>, doc array<int>, tf array<long>"
POSTINGS = "owner int, shard long, term array<int>, doc array<int>, impact array<long>, doc_ids array<long>"
BUNDLE = "shard long, item int, docs array<int>, scores array<long>, rest array<long>"
FOUND = "shard long, uid long, doc_id long, score long"


class Index:
    """A block's items: their distinct terms, by number, and the terms' bytes."""

    def __init__(self, texts: list[str]) -> None:
        words = Words(pa.array(texts, pa.string()), ITEM_WORDS, lower=True)
        numbers: dict[bytes, int] = {}
        self.items = [np.unique([numbers.setdefault(words.word(j), len(numbers)) for j in range(words.first[i], words.first[i + 1])]).astype(np.int32) for i in range(len(texts))]
        terms = list(numbers)
        own = Words(pa.array([t.decode() for t in terms], pa.string()), ITEM_WORDS)
        h = own.hashes()
        # terms of one hash lie side by side; a word is compared with each of them
        self.order = np.lexsort((np.arange(len(h)), h)).astype(np.int32)
        self.hashes, self.data, self.start, self.length = h[self.order], own.data, own.start[self.order], (own.end - own.start)[self.order]
        self.same = int(np.unique(self.hashes, return_counts=True)[1].max(initial=1))
        self.terms = len(terms)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and which terms."""
        h = words.hashes()
        low = np.searchsorted(self.hashes, h)
        at, term = [], []
        for step in range(self.same):
            word = np.flatnonzero(low + step < self.terms)
            slot = low[word] + step
            same = self.hashes[slot] == h[word]
            word, slot = word[same], slot[same]
            lengths = words.end[word] - words.start[word]
            fits = lengths == self.length[slot]
            word, slot, lengths = word[fits], slot[fits], lengths[fits]
            inside = ranges(lengths)
            equal = words.data[np.repeat(words.start[word], lengths) + inside] == self.data[np.repeat(self.start[slot], lengths) + inside]
            fits = np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths) if len(word) else np.zeros(0, bool)
            at.append(word[fits])
            term.append(self.order[slot[fits]])
        return np.concatenate(at), np.concatenate(term)


def _lists(values: np.ndarray, offsets: list[int] | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _one(values: np.ndarray) -> pa.Array:
    return _lists(values, [0, len(values)])


def shards_of(batches: Iterator[pa.RecordBatch], index: Index, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Shards with their documents' ids and lengths, and their postings in the order of terms. Columns: doc_id, text."""
    number, docs, size, held = 0, 0, 0, []

    def shard() -> pa.RecordBatch:
        nonlocal number, docs, size, held
        ids, n, doc, term, tf = ([x[c] for x in held] for c in range(5))
        order = np.argsort(np.concatenate(term), kind="stable")
        name = (TaskContext.get().partitionId() << 32) + number
        lists = [_one(np.concatenate(c)[order]) for c in (term, doc, tf)]
        ids = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), pa.concat_arrays(ids))
        number, docs, size, held = number + 1, 0, 0, []
        return pa.RecordBatch.from_arrays([pa.array([name]), ids, _one(np.concatenate(n)), *lists], ["shard", "doc_ids", "n", "term", "doc", "tf"])

    for batch in pieces(batches, "text"):
        words = Words(batch.column(1), ITEM_WORDS, lower=True)
        at, term = index.find(words)
        key, tf = np.unique(words.text_of_word()[at] * np.int64(max(index.terms, 1)) + term, return_counts=True)
        doc, term = np.divmod(key, np.int64(max(index.terms, 1)))
        held.append((batch.column(0), words.counts.astype(np.int64), (doc + docs).astype(np.int32), term.astype(np.int32), tf.astype(np.int64)))
        docs, size = docs + batch.num_rows, size + len(words.data)
        if size >= shard_bytes or docs >= SHARD_DOCS:
            yield shard()
    if held:
        yield shard()


def sums_of(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, then N and L under the next two numbers. Columns: n, term."""
    total = np.zeros(terms + 2, np.int64)
    for batch in batches:
        n, term = (batch.column(c).flatten().to_numpy() for c in range(2))
        total[:terms] += np.bincount(term, minlength=terms)
        total[terms:] += [np.count_nonzero(n), n.sum()]
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "total"])


class Weights:
    """Weights and owners of a block's terms, and the items' terms by owner."""

    def __init__(self, index: Index, uids: list[int], df: np.ndarray, documents: int, length: int, owners: int) -> None:
        self.uids, self.documents, self.length, self.owners = np.array(uids, np.int64), documents, length, owners
        self.w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        uses = np.bincount(np.concatenate([*index.items, np.zeros(0, np.int32)]), minlength=index.terms)
        order = np.argsort(-self.w, kind="stable")
        seen = np.cumsum(uses[order])
        self.owner = np.empty(index.terms, np.int32)
        self.owner[order] = np.minimum((seen - 1) * owners // max(int(seen[-1]) if len(seen) else 1, 1), owners - 1)
        self.items = [[x[self.owner[x] == s] for s in range(owners)] for x in index.items]

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of each document."""
        if 90 * int(n.max(initial=0)) * self.documents < 1 << 63:
            return 10 + 90 * n * self.documents // self.length
        return np.array([10 + 90 * int(x) * self.documents // self.length for x in n], np.int64)


def postings_of(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """A shard's postings by owner; under owner -1 each term's largest impact in the shard. The last owner's rows bear the documents' ids."""
    names = [f.split()[0] for f in POSTINGS.split(", ")]
    for batch in batches:
        for row in range(batch.num_rows):
            shard, ids = batch.column(0).slice(row, 1), batch.column(1).slice(row, 1)
            n, term, doc, tf = (batch.column(c).slice(row, 1).flatten().to_numpy() for c in range(2, 6))
            m = weights.lengths(n)[doc]
            impact = weights.w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            some = impact > 0
            term, doc, impact = term[some], doc[some], impact[some]
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            if not len(first):
                continue
            none = pa.array([None], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), shard, _one(term[first]), _one(np.zeros(0, np.int32)), _one(np.maximum.reduceat(impact, first)), none], names)
            owner = weights.owner[term]
            for s in range(weights.owners):
                own = owner == s
                last = s == weights.owners - 1
                if last or own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), shard, _one(term[own]), _one(doc[own]), _one(impact[own]), ids if last else none], names)


def bundles_of(batches: Iterator[pa.RecordBatch], weights: Weights, terms: int) -> Iterator[pa.RecordBatch]:
    """For each shard, a bundle of each item that shares a term with it, and what each owner's successors can add at most. Columns: shard, term, impact."""
    for batch in batches:
        for row in range(batch.num_rows):
            term, impact = (batch.column(c).slice(row, 1).flatten().to_numpy() for c in (1, 2))
            most = np.zeros(terms, np.int64)
            most[term] = impact
            by_owner = np.array([[most[x].sum() for x in item] for item in weights.items], np.int64).reshape(len(weights.items), weights.owners)
            item = np.flatnonzero(by_owner.any(axis=1))
            later = by_owner[item][:, ::-1].cumsum(axis=1)[:, ::-1] - by_owner[item]
            count = len(item)
            empty = np.zeros(count + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(count, batch.column(0)[row].as_py(), np.int64)), pa.array(item.astype(np.int32)), _lists(np.zeros(0, np.int32), empty), _lists(np.zeros(0, np.int64), empty), _lists(later.ravel(), np.arange(count + 1) * weights.owners)],
                [f.split()[0] for f in BUNDLE.split(", ")],
            )


def visit(bundles: pa.Table, postings: pa.Table, weights: Weights, owner: int, k: int) -> pa.Table:
    """Bundles of a shard after their visit to an owner; the last owner returns their k best documents instead."""
    last = owner == weights.owners - 1
    names = [f.split()[0] for f in (FOUND if last else BUNDLE).split(", ")]
    if not postings.num_rows and not last:
        return bundles
    column = lambda t, c: t.column(c).combine_chunks()
    term, doc, impact = (column(postings, c).flatten().to_numpy() for c in ("term", "doc", "impact"))
    ids = column(postings, "doc_ids").flatten() if last else pa.array([], pa.int64())
    held, old = (column(bundles, c).flatten().to_numpy() for c in ("docs", "scores"))
    begin = np.append(0, np.cumsum(column(bundles, "docs").value_lengths().to_numpy())).astype(np.int64)
    items, rest = bundles.column("item").to_numpy(), column(bundles, "rest").flatten().to_numpy().reshape(-1, weights.owners)
    score = np.zeros(1 + max(int(doc.max(initial=0)), int(held.max(initial=0))), np.int64)
    ties = np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), 1, 0) if last else None
    id_of = pc.fill_null(ids, 0).to_numpy() if last else None
    docs, scores, which = [], [], []
    for b, i in enumerate(items.tolist()):
        own = weights.items[i][owner]
        low, high = np.searchsorted(term, own), np.searchsorted(term, own, side="right")
        parts = [held[begin[b] : begin[b + 1]], *(doc[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True) if y > x)]
        score[parts[0]] = old[begin[b] : begin[b + 1]]
        for x, y in zip(low.tolist(), high.tolist(), strict=True):
            score[doc[x:y]] += impact[x:y]
        some = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        total = score[some]
        score[some] = 0
        if len(some) > k:
            enough = total + rest[b, owner] >= np.partition(total, -k)[-k]
            some, total = some[enough], total[enough]
        if last:
            best = np.lexsort((id_of[some], ties[some], -total))[:k]
            some, total = some[best], total[best]
        docs.append(some)
        scores.append(total)
        which.append(len(some))
    docs, scores = (np.concatenate([*x, np.zeros(0, kind)]).astype(kind) for x, kind in ((docs, np.int32), (scores, np.int64)))
    shard = bundles.column("shard")
    if last:
        at = np.repeat(np.arange(len(items)), which)
        return pa.table([shard.take(pa.array(at)), pa.array(weights.uids[items[at]]), ids.take(pa.array(docs)), pa.array(scores)], names)
    offsets = np.append(0, np.cumsum(which))
    return pa.table([shard, bundles.column("item"), _lists(docs, offsets), _lists(scores, offsets), bundles.column("rest")], names)


def _visitor(weights: Broadcast, owner: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda bundles, postings: visit(bundles, postings, weights.value, owner, k)


def _blocks(items: DataFrame, most_chars: int) -> tuple[DataFrame, list[int]]:
    """The items with the number of their block, and all numbers; a block has at most ``most_chars`` characters, or one item."""
    count = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // most_chars))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(count)))
        full = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).where((F.col("chars") > most_chars) & (F.col("n") > 1))
        if full.isEmpty():
            return dealt, list(range(count))
        count *= 2


def ranked(docs: DataFrame, items: DataFrame, k: int = K, owners: int = OWNERS, most_chars: int = MOST_CHARS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's ``k`` best documents."""
    items = materialize(items.where("text is not null").select(F.col("item_id").cast("long"), "text", F.monotonically_increasing_id().alias("uid")), "lexical-items")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dealt, blocks = _blocks(items, most_chars)
    found = [_ranked_block(docs, dealt.where(F.col("block") == b), k, owners, shard_bytes) for b in blocks]
    found = [x for x in found if x is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for other in found[1:]:
        best = best.unionByName(other)
    ranks = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = best.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return best.join(items.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")


def _ranked_block(docs: DataFrame, block: DataFrame, k: int, owners: int, shard_bytes: int) -> DataFrame | None:
    """uid, doc_id and score of the best documents in each group of shards, for the items of one block."""
    spark = docs.sparkSession
    rows = block.select("uid", "text").orderBy("uid").collect()  # bounded by _blocks
    index = Index([r["text"] for r in rows])
    if not index.terms:
        return None
    shared = spark.sparkContext.broadcast(index)
    slices = materialize(docs.mapInArrow(lambda batches: shards_of(batches, shared.value, shard_bytes), SLICE), "lexical-slices")
    terms = index.terms
    totals = slices.select("n", "term").mapInArrow(lambda batches: sums_of(batches, terms), "term int, total long").groupBy("term").agg(F.sum("total").alias("total"))
    sums = np.zeros(terms + 2, np.int64)
    for r in totals.collect():
        sums[r["term"]] = r["total"]
    if not sums[terms]:
        return None
    weights = spark.sparkContext.broadcast(Weights(index, [r["uid"] for r in rows], sums[:terms], int(sums[terms]), int(sums[terms + 1]), owners))
    postings = materialize(slices.mapInArrow(lambda batches: postings_of(batches, weights.value), POSTINGS), "lexical-postings", slices, by=("owner",))
    bundles = postings.where("owner = -1").select("shard", "term", "impact").mapInArrow(lambda batches: bundles_of(batches, weights.value, terms), BUNDLE)
    for owner in range(owners):
        owned = postings.where(F.col("owner") == owner).select("shard", "term", "doc", "impact", "doc_ids")
        bundles = bundles.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(_visitor(weights, owner, k), FOUND if owner == owners - 1 else BUNDLE)
    found = materialize(bundles, "lexical-found")
    discard(postings)
    groups = max(1, math.isqrt(found.select("shard").distinct().count()))
    near = Window.partitionBy("uid", F.pmod(F.xxhash64("shard"), F.lit(groups))).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("near", F.row_number().over(near)).where(F.col("near") <= k).select("uid", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term),
sizes AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY rid),
facts AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sizes),
lengths AS (SELECT rid, 10 + (90 * n * docs) // length AS m FROM sizes, facts),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), facts),
q AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest(w) AS term FROM q)),
scores AS (SELECT qid, rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM asked JOIN t USING (term) JOIN weights USING (term) JOIN lengths USING (rid) GROUP BY qid, rid),
ranked AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN q USING (qid) WHERE rank <= 10
"""
