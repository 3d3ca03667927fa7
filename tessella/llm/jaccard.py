"""N-gram Jaccard join by vertical partitioning (operator 2).

A document's set is that of its distinct n-word shingles, each a 64-bit hash; hashes give the global order of
shingles, and ranges of that order are the fragments. Two documents link when ``den * overlap >= num * union``.

1. Documents with the same set (by 128 bits) are a class; from here on the document with its smallest doc_id stands for it.
2. Candidates: linked sets differ in at most D shingles, D growing with their sizes. With more than D fragments, one
   fragment at least is the same in both, so each document offers one signature for each non-empty fragment,
   and sets that share none can't link. The number of fragments depends on the size interval alone; sets that
   could link across the bound of two intervals offer signatures for that bound too. Sets with so many empty fragments
   that the argument would fail also offer the first shingles of the order (prefix filter).
3. Signatures meet in ranges of their values. A slice of the input sends each distinct one once, with the smallest document
   that has it there, packed by range; a range finds the smallest of all. So documents with a common signature hang
   together in a tree of at most two levels, slice leaders below one leader, and no bucket is expanded into its pairs.
4. Comparison of each document with the smallest of its leaders: bit sketches of the sets give an upper bound of the
   overlap; for pairs that pass, the sets are cut at fixed points of the order, overlaps are counted for each fragment by
   itself, and the counts are summed per pair.
5. Trees whose documents lie in several components of these links go on. Of their documents those leave that have so many
   shingles found in no other of them that every partner is ruled out. The rest make clusters by their trees, and these are
   dealt to tiles (a bounded number of documents) by size, so that most pairs of tiles can't link. In the other pairs of
   tiles the bit sketches meet; only documents with a possible partner of another component are compared there, again
   fragment by fragment; a pair of tiles reports a spanning forest of its links.
6. What steps 4 and 5 send is dealt to rounds of bounded size by the pairs of tiles, or by the leaders; a round's files go
   before the next, so that large clusters take more rounds and not more disk.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; with fewer
words than n the whole sequence is the one shingle; a text of any length is one set, whole; equal texts are linked; rows
with a null doc_id link with nothing and have no component; doc_id should be unique, but repeated rows do no harm; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, load, materialize
from .graph import components, forest
from .skew import spread_join
from .words import SPACE_WORDS, Words, gram_hashes, gram_starts, mix64, of_six_bytes, order_by, pieces, ranges, segments_of, six_bytes, tasks_for

RATIO, SLACK, CUTS, MOST_BROADCAST_IDS, TILE_DOCS, TILE_SHINGLES = 1.8, 0.1, 4, 2_000_000, 1200, 1_000_000
#: Bytes of text a slice, shingles a range, tasks that share a class of equal sets.
SLICE_BYTES, SEGMENT_SHINGLES, CLASS_SALTS = 2 << 20, 1 << 19, 16
FEW, PAIRS_AT_ONCE = 32, 1 << 22
#: Bytes that a round may send at least, and a shingle of the input; sizes of a tile's step, as a factor; bytes of sketches in a product.
ROUND_BYTES, ROUND_SHARE, STEP, SKETCH_BLOCK = 1 << 28, 2, 1.05, 4096
BOUNDS = [1]
while BOUNDS[-1] < 1 << 40:
    BOUNDS.append(max(BOUNDS[-1] + 1, int(BOUNDS[-1] * RATIO)))


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of every distinct shingle, by text and hash; and how many each text has."""
    words = Words(column, SPACE_WORDS, lower=True)
    h = words.hashes()
    starts, counts = gram_starts(words.first, n)
    of, grams = np.repeat(np.arange(len(counts)), counts), gram_hashes(h, n)[starts]
    for k in range(1, n):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            of, grams = np.concatenate([of, short]), np.concatenate([grams, gram_hashes(h, k)[words.first[short]]])
    order = order_by(of, grams)
    of, grams = of[order], grams[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    of, grams = of[new], grams[new]
    return of, grams, np.bincount(of, minlength=len(counts))


def _sums(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums modulo 2^64 over runs of equal keys, and where the runs begin."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (np.add.reduceat(values, at) if len(at) else values[:0]), at


def set_hashes(of: np.ndarray, grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, n), np.uint64)
    for i, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        total, at = _sums(mix64(grams ^ np.uint64(salt)), of)
        out[i, of[at]] = mix64(total)
    return out[0].view(np.int64), out[1].view(np.int64)


def schemes(sizes: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scheme number, differences D, applies) for each text: for its own size interval, and for the bounds below and above it."""
    bounds = np.array(BOUNDS, np.int64)
    own = np.searchsorted(bounds, np.maximum(sizes, 1), side="right") - 1
    top = bounds[own + 1] - 1
    low, high = bounds[own], bounds[own + 1]
    differ = lambda total: total * (den - num) // (num + den)
    out = [(2 * own, differ(2 * top), sizes > 0)]
    # up: x below the bound `high`, partner at most x * den / num; down: the same bound seen from above
    out.append((2 * own + 1, differ(top + top * den // num), (sizes > 0) & (sizes * den >= num * high)))
    below = low - 1
    out.append((2 * own - 1, differ(below + below * den // num), (sizes > 0) & (own > 0) & (below * den >= num * sizes)))
    return out


def signatures(of: np.ndarray, grams: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature)."""
    texts, found = [], []
    mixed = mix64(grams ^ np.uint64(0x8BB84B93962EACC9))
    sparse = np.zeros(len(sizes), bool)
    for scheme, differ, applies in schemes(sizes, num, den):
        m = differ + 1 + np.ceil((differ + 1) * SLACK).astype(np.int64) * (differ > 0)
        use = applies[of] & (differ[of] > 0)  # no difference allowed: only equal sets, which are one class
        o, g, v = of[use], grams[use], mixed[use]
        fragment = (g >> np.uint64(32)) * m[o].astype(np.uint64) >> np.uint64(32)
        key = (o.astype(np.uint64) << np.uint64(32)) + fragment
        total, at = _sums(v, key)
        o, fragment = o[at], fragment[at]
        texts.append(o)
        found.append(mix64(total + mix64((scheme[o].astype(np.uint64) << np.uint64(40)) + fragment)))
        filled = np.bincount(o, minlength=len(sizes))
        sparse |= applies & (differ > 0) & (filled <= differ)
    if sparse.any():
        prefix = sizes - -(-sizes * num // den) + 1
        rank = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
        use = sparse[of] & (rank < prefix[of])
        texts.append(of[use])
        found.append(mix64(grams[use] ^ np.uint64(0xA0761D6478BD642F)))
    # 48 bits tell signatures apart well enough for candidates, and zeros shrink in a shuffle
    return np.concatenate(texts), np.concatenate(found) & ~np.uint64(0xFFFF)


def _batch(names: list[str], *arrays: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names)


def sketches(of: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set a bit for each of 2^k ranges of (mixed) hashes, at least twice as many as it has shingles."""
    mixed, first, out = mix64(grams ^ np.uint64(0x589965CC75374CC3)), np.append(0, np.cumsum(sizes)), []
    for i, n in enumerate(sizes.tolist()):
        width = max(6, int(2 * n - 1).bit_length())
        bits = np.zeros(1 << width, bool)
        bits[(mixed[first[i] : first[i + 1]] >> np.uint64(64 - width)).astype(np.int64)] = True
        out.append(np.packbits(bits).tobytes())
    return out


def most_overlap(size_a: int, a: bytes, size_b: int, b: bytes) -> int:
    """An upper bound: each range that only one set has holds a shingle that the other lacks."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)).astype(bool) for v in (a, b))
    n = min(len(x), len(y))
    x, y = x.reshape(n, -1).any(axis=1), y.reshape(n, -1).any(axis=1)
    return min(size_a - int((x & ~y).sum()), size_b - int((y & ~x).sum()))


def _bits(rows: np.ndarray, begin: int, end: int, fold: int) -> np.ndarray:
    """Bits of the bytes from begin to end of each sketch after each ``fold`` ranges became one, as 0 and 1."""
    bits = np.unpackbits(rows[:, begin * fold : end * fold], axis=1)
    return (bits.reshape(len(rows), -1, fold).any(axis=2) if fold > 1 else bits).astype(np.float32)


def possible_partners(sizes: np.ndarray, sketch: list[bytes], group: np.ndarray, second: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of a tile's documents (second: false) and another's have one in the other tile that could link with them, of another group.

    If none is ``second``, within one tile. The bound is that of ``most_overlap``.
    """
    width, keep = np.array([len(v) for v in sketch], np.int64), np.zeros(len(sizes), bool)
    x, y = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(sizes)),) * 2
    for m in np.unique(width[x]):
        i = x[width[x] == m]
        a = np.frombuffer(b"".join(sketch[k] for k in i), np.uint8).reshape(len(i), m)
        for n in np.unique(width[y]):
            j = y[width[y] == n]
            if den * sizes[i].max() < num * sizes[j].min() or den * sizes[j].max() < num * sizes[i].min():
                continue
            b = np.frombuffer(b"".join(sketch[k] for k in j), np.uint8).reshape(len(j), n)
            both, in_a, in_b = np.zeros((len(i), len(j))), np.zeros(len(i)), np.zeros(len(j))
            for k in range(0, w := int(min(m, n)), SKETCH_BLOCK):
                u, v = (_bits(c, k, min(k + SKETCH_BLOCK, w), int(z) // w) for c, z in ((a, m), (b, n)))
                both += u @ v.T
                in_a += u.sum(axis=1)
                in_b += v.sum(axis=1)
            most = both + np.minimum((sizes[i] - in_a)[:, None], (sizes[j] - in_b)[None, :])
            may = ((num + den) * most >= num * (sizes[i][:, None] + sizes[j][None, :])) & (group[i][:, None] != group[j][None, :])
            keep[i] |= may.any(axis=1)
            keep[j] |= may.any(axis=0)
    return keep


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _runs(h: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)


class _Join:
    """One join: the documents (doc_id, text), shingle length and threshold."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int) -> None:
        if not den < RATIO * num or num > den:
            raise ValueError(f"the threshold must be above 1 / {RATIO} and at most 1: {num} / {den}")
        self.docs, self.n, self.num, self.den = docs, n, num, den
        self.spark = docs.sparkSession
        self.n_docs, self.room, self.texts = 0, ROUND_BYTES, []
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def sets(self) -> DataFrame:
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                of, grams, sizes = shingle_sets(batch.column(1), n)
                h1, h2 = set_hashes(of, grams, len(sizes))
                yield _batch(["doc_id", "n_shingles", "h1", "h2"], batch.column(0), pa.array(sizes), pa.array(h1), pa.array(h2))

        made = materialize(self.docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long"), "jaccard-sets")
        self.n_docs = made.count()
        return made

    def of(self, ids: DataFrame) -> DataFrame:
        """The documents with these ids (column id). Beyond a number of them texts are shuffled, and written so that every run of a task sees the same."""
        few = self.n_docs <= MOST_BROADCAST_IDS or ids.count() <= MOST_BROADCAST_IDS
        found = self.docs.join(F.broadcast(ids) if few else ids, self.docs["doc_id"] == ids["id"], "left_semi")
        if few:
            return found
        self.texts.append(materialize(found, "jaccard-texts"))
        return self.texts[-1]

    def written(self, df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
        """``df``, materialized; the texts written for it, which are as large as the input, go."""
        out = materialize(df, name, *spent, *self.texts)
        self.texts = []
        return out

    def rounds(self, sent: int | None) -> int:
        """How many rounds take so many bytes."""
        return max(1, -(-int(sent or 0) // self.room))

    def trees(self, docs: DataFrame, shingles: int) -> DataFrame:
        """leader, id: documents with a common signature hang together; see step 3."""
        n, num, den, segments = self.n, self.num, self.den, max(self.partitions, shingles // SEGMENT_SHINGLES)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", SLICE_BYTES):
                ids = batch.column(0).to_numpy()
                of, grams, sizes = shingle_sets(batch.column(1), n)
                texts, sig = signatures(of, grams, sizes, num, den)
                own = ids[texts]
                order = np.argsort(sig)
                own, sig = own[order], sig[order]
                at = _runs(sig)
                least = np.minimum.reduceat(own, at) if len(at) else own
                leader = np.repeat(least, np.diff(np.append(at, len(sig))))
                below = own != leader
                a, b = _distinct_pairs(leader[below], own[below])
                sig, own = sig[at], least
                segment, first = segments_of(sig, segments)
                bounds = np.append(first, len(sig)).tolist()
                six = six_bytes(sig)
                # the bytes of ids go plane by plane, as most planes are zeros
                packed = [six[x:y].tobytes() + own[x:y].view(np.uint8).reshape(-1, 8).T.tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                if len(a):
                    segment = np.append(segment, int(ids[0]) % segments)
                    packed.append(b"".join(v.view(np.uint8).reshape(-1, 8).T.tobytes() for v in (a, b)))
                entries = np.diff(bounds).tolist() + [0] * bool(len(a))
                yield _batch(["segment", "entries", "packed"], pa.array(segment, pa.int64()), pa.array(entries, pa.int32()), pa.array(packed, pa.binary()))

        def ids_of(data: bytes, n: int, at: int) -> np.ndarray:
            return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            segment, sigs, owners = None, [], []

            def flush() -> pa.RecordBatch:
                sig, own = np.concatenate(sigs), np.concatenate(owners)
                order = np.argsort(sig)
                sig, own = sig[order], own[order]
                at = _runs(sig)
                least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(sig))))
                below = own != least
                a, b = _distinct_pairs(least[below], own[below])
                return _batch(["leader", "id"], pa.array(a), pa.array(b))

            for batch in batches:
                for s, entries, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s != segment and sigs:
                        yield flush()
                        sigs, owners = [], []
                    segment = s
                    if entries:
                        sigs.append(of_six_bytes(packed, entries))
                        owners.append(ids_of(packed, entries, 6 * entries))
                    else:
                        k = len(packed) // 16
                        yield _batch(["leader", "id"], pa.array(ids_of(packed, k, 0)), pa.array(ids_of(packed, k, 8 * k)))
            if sigs:
                yield flush()

        sent = docs.mapInArrow(send, "segment long, entries int, packed binary")
        met = sent.repartition(tasks_for(self.partitions, segments), "segment").sortWithinPartitions("segment").mapInArrow(meet, "leader long, id long")
        return self.written(met.distinct(), "jaccard-trees")

    def sketched(self, ids: DataFrame) -> DataFrame:
        """id, size and sketch of the documents with these ids."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                of, grams, sizes = shingle_sets(batch.column(1), n)
                yield _batch(["id", "size", "sketch"], batch.column(0), pa.array(sizes), pa.array(sketches(of, grams, sizes), pa.binary()))

        return self.of(ids).mapInArrow(run, "id long, size long, sketch binary")

    def segments(self, ids: DataFrame) -> DataFrame:
        """id, size, cut and the hashes of that cut, of the documents with these ids."""
        n, shift = self.n, np.uint64(64 - (CUTS - 1).bit_length())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                of, grams, sizes = shingle_sets(batch.column(1), n)
                key = of * CUTS + (grams >> shift).astype(np.int64)
                at = _runs(key)
                owner = of[at]
                hashes = pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)), pa.array(grams.view(np.int64)))
                yield _batch(["id", "size", "cut", "hashes"], batch.column(0).take(pa.array(owner)), pa.array(sizes[owner]), pa.array((key[at] % CUTS).astype(np.int32)), hashes)

        return self.of(ids).mapInArrow(run, "id long, size long, cut int, hashes array<long>")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) that sketches don't rule out, and the sum of their sizes."""
        num, den = self.num, self.den
        facts = self.written(self.sketched(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "jaccard-sketches")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [(num + den) * most_overlap(m, x, n, y) >= num * (m + n) for m, x, n, y in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)]
                yield _batch(["a", "b", "total"], *(c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:3]))

        sides = [facts.select(F.col("id").alias(k), F.col("size").alias(f"size_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab"]
        both = spread_join(pairs.join(sides[1], "b").select("a", "b", "size_b", "sketch_b"), sides[0], ["a"], ["b"], counted=pairs)
        # sizes that far apart can't link, whatever the sets
        near = both.where((F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num))
        return materialize(near.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("total"), "size_a", "sketch_a", "size_b", "sketch_b").mapInArrow(run, "a long, b long, total long"), "jaccard-pairs", facts)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b, total) that are similar enough."""
        # a pair's hashes are written for both sides, and those of one or both are sent twice
        n = self.rounds(pairs.agg(F.sum("total") * 24).first()[0])
        return _union([self.linked_now(pairs.where(F.pmod(F.xxhash64("a"), F.lit(n)) == k).select("a", "b")) for k in range(n)])

    def linked_now(self, pairs: DataFrame) -> DataFrame:
        ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")
        cuts = self.written(self.segments(ids), "jaccard-segments", ids)
        left = cuts.select(F.col("id").alias("a"), F.col("size").alias("size_a"), "cut", F.col("hashes").alias("left"))
        right = cuts.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "cut", F.col("hashes").alias("right"))
        partial = spread_join(pairs, left, ["a"], ["b"]).join(right, ["b", "cut"]).select("a", "b", "size_a", "size_b", F.size(F.array_intersect("left", "right")).alias("n"))
        whole = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
        sure = whole.where((self.num + self.den) * F.col("n") >= self.num * (F.col("size_a") + F.col("size_b"))).select("a", "b")
        return materialize(sure, "jaccard-links", cuts)

    def sociable(self, ids: DataFrame, shingles: int) -> DataFrame:
        """Those ids whose shingles in other documents of ``ids`` suffice for a link with some partner."""
        n, segments, num, den = self.n, max(self.partitions, shingles // SEGMENT_SHINGLES), self.num, self.den

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row a range with the slice's distinct shingles there, the (first) document of each, and whether it is the only one here."""
            for batch in pieces(batches, "text", SLICE_BYTES):
                of, grams, sizes = shingle_sets(batch.column(1), n)
                order = np.argsort(grams)
                h, of = grams[order], of[order]
                at = _runs(h)
                alone = np.diff(np.append(at, len(h))) == 1
                h, of = h[at], of[at]
                segment, first = segments_of(h, segments)
                bounds = np.append(first, len(h)).tolist()
                name = hash((tuple(batch.column(0).to_pylist()), int(grams.sum())))
                kind = "<u2" if len(sizes) <= 1 << 15 else "<u4"
                six, owner = six_bytes(h), (of.astype(kind) << 1) | alone.astype(kind)
                packed = [six[x:y].tobytes() + owner[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                head = batch.column(0).to_numpy().tobytes() + sizes.astype("<i8").tobytes()
                rows = [[name] * (len(packed) + 1), [*segment.tolist(), name % segments], [*np.diff(bounds).tolist(), -1], [*packed, head]]
                yield _batch(["slice", "segment", "entries", "packed"], *(pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Back to each slice: which of its documents have how many shingles of a range alone."""
            segment, names, hashes, owners = None, [], [], []

            def flush() -> pa.RecordBatch:
                h = np.concatenate(hashes)
                _, where, times = np.unique(h, return_inverse=True, return_counts=True)
                once, out, at = times[where] == 1, [], 0
                for own in owners:
                    alone = once[at : at + len(own)] & (own & 1).astype(bool)
                    at += len(own)
                    docs, times = np.unique((own >> 1)[alone], return_counts=True)
                    out.append(np.stack([docs, times]).astype("<u4").tobytes())
                return _batch(["slice", "entries", "packed"], pa.array(names), pa.array([0] * len(names), pa.int32()), pa.array(out, pa.binary()))

            for batch in batches:
                for name, s, entries, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if s != segment and names:
                        yield flush()
                        names, hashes, owners = [], [], []
                    segment = s
                    if entries < 0:
                        yield _batch(["slice", "entries", "packed"], pa.array([name]), pa.array([-1], pa.int32()), pa.array([packed], pa.binary()))
                    else:
                        names.append(name)
                        hashes.append(of_six_bytes(packed, entries))
                        owners.append(np.frombuffer(packed, "<u2" if len(packed) == 8 * entries else "<u4", entries, 6 * entries))
            if names:
                yield flush()

        def gather(rows: pa.Table) -> pa.Table:
            head = next(p for e, p in zip(rows.column("entries").to_pylist(), rows.column("packed").to_pylist(), strict=True) if e < 0)
            ids, sizes = np.frombuffer(head, "<i8").reshape(2, -1)
            alone = np.zeros(len(ids), np.int64)
            for e, p in zip(rows.column("entries").to_pylist(), rows.column("packed").to_pylist(), strict=True):
                if e == 0:
                    docs, times = np.frombuffer(p, "<u4").reshape(2, -1)
                    alone[docs] += times
            # overlap <= shared, so a partner has at most shared * (num + den) / num - size shingles, and at least size * num / den
            most = np.minimum((sizes - alone) * (num + den) // num - sizes, sizes * den // num)
            keep = most >= -(-sizes * num // den)
            return pa.table([pa.array(ids[keep])], ["id"])

        sent = self.of(ids).mapInArrow(send, "slice long, segment long, entries int, packed binary")
        back = sent.repartition(tasks_for(self.partitions, segments), "segment").sortWithinPartitions("segment").mapInArrow(count, "slice long, entries int, packed binary")
        return self.written(back.groupBy("slice").applyInArrow(gather, "id long").distinct(), "jaccard-sociable")

    def linked_in_clusters(self, left: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
        """Links (a, b), a spanning forest of them, among documents that trees of ``left`` (leader, id) connect.

        Nothing that could link is left out: a cluster holds all trees that share documents, and a document goes only if
        its shingles that no other document has rule out every partner, or if all whose size and sketch don't are in its own
        component of ``groups`` (node, component).
        """
        num, den, ids = self.num, self.den, materialize(left.select(F.col("leader").alias("id")).union(left.select("id")).distinct(), "jaccard-open")
        for _ in range(2):
            shingles = sets.join(ids, sets["doc_id"] == ids["id"], "left_semi").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
            ids = self.sociable(ids, shingles)
        own = left.join(ids, "id", "left_semi")
        # a slice's leader that leaves still ties its documents to the leader above
        ties = own.union(left.join(own.select(F.col("leader").alias("id")).distinct(), "id", "left_semi").select("leader", "id")).distinct()
        cluster = components(ties.select(F.col("leader").alias("a"), F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(ids, "id", "left_semi")
        cluster = cluster.join(sets.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("weight")).dropDuplicates(["id"]), "id")
        component = groups.select(F.col("node").alias("id"), F.col("component").alias("group"))
        cluster = materialize(cluster.join(component, "id", "left").withColumn("group", F.coalesce("group", "id")), "jaccard-clusters")
        tiled = materialize(placed(cluster), "jaccard-tiled", cluster)
        pairs = materialize(pairs_of_tiles(tiled, num, den), "jaccard-tiles")
        near = self.near(tiled, pairs)
        discard(tiled, pairs)
        n = self.rounds(near.agg(F.sum("size") * 8).first()[0])
        return _union([self.compared(near.where(F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(n)) == k)) for k in range(n)])

    def near(self, tiled: DataFrame, pairs: DataFrame) -> DataFrame:
        """cluster, low, high, second, id, size: the documents that have a possible partner in a pair of tiles."""
        num, den = self.num, self.den
        facts = self.written(self.sketched(tiled.select("id")), "jaccard-sketches")

        def run(table: pa.Table) -> pa.Table:
            sizes, group, second = (table.column(c).to_numpy() for c in ("size", "group", "second"))
            keep = possible_partners(sizes, table.column("sketch").to_pylist(), group, second, num, den)
            return table.select(["cluster", "low", "high", "second", "id", "size"]).filter(pa.array(keep))

        # a sketch takes at most half a byte a shingle, or 8
        n, out = self.rounds(pairs.agg(F.sum(F.col("weight") / 2 + F.col("n") * 64)).first()[0]), []
        for k in range(n):
            here = pairs.where(F.pmod(F.xxhash64("cluster", "low", "high"), F.lit(n)) == k).select("cluster", "tile", "low", "high", "second")
            sent = tiled.select("id", "cluster", "tile", "group").join(facts, "id").join(here, ["cluster", "tile"]).drop("tile")
            sent = sent.select("cluster", "low", "high", "second", "id", "size", "group", "sketch")
            out.append(materialize(sent.groupBy("cluster", "low", "high").applyInArrow(run, "cluster long, low int, high int, second boolean, id long, size long"), "jaccard-near"))
        discard(facts)
        return _union(out)

    def compared(self, near: DataFrame) -> DataFrame:
        """Links (a, b), a spanning forest in each pair of tiles."""
        num, den = self.num, self.den

        def compare(table: pa.Table) -> pa.Table:
            own = [table.column(c).to_numpy() for c in ("id", "size", "cut", "second")]
            parts = table.column("hashes").combine_chunks()
            counts, flat = np.diff(parts.offsets.to_numpy()), parts.flatten().to_numpy()
            a, b = tile_links(*own, counts, flat, num, den)
            return pa.table([pa.array(a), pa.array(b)], ["a", "b"])

        ids = materialize(near.select("id").distinct(), "jaccard-ids")
        sent = self.segments(ids).join(near.drop("size"), "id").select("cluster", "low", "high", "second", "id", "size", "cut", "hashes")
        return self.written(sent.groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long"), "jaccard-links", ids)


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def placed(cluster: DataFrame) -> DataFrame:
    """``cluster`` (id, cluster, weight, group) with the tile of each document; tiles follow the sizes, in steps."""
    step = F.floor(F.log(F.greatest("weight", F.lit(1))) / math.log(STEP)).cast("int")
    fill = F.greatest(F.count("*") / TILE_DOCS, F.sum("weight") / TILE_SHINGLES)
    steps = cluster.groupBy("cluster", step.alias("step")).agg(fill.alias("fill"))
    own = Window.partitionBy("cluster")
    steps = steps.withColumn("end", F.sum("fill").over(own.orderBy("step"))).withColumn("all", F.sum("fill").over(own))
    # clusters of more than one tile: some hundred steps, and at most 1 / TILE_DOCS as many as documents, or as their shingles fill tiles
    steps = steps.where("all > 1").select("cluster", "step", F.floor(F.col("end") - F.col("fill")).cast("int").alias("first"), F.ceil("end").cast("int").alias("end"))
    dealt = cluster.withColumn("step", step).join(F.broadcast(steps), ["cluster", "step"], "left")
    # a step that ends within a tile shares it with the next one
    tile = F.col("first") + F.pmod(F.xxhash64("id"), F.greatest(F.col("end") - F.col("first"), F.lit(1))).cast("int")
    return dealt.select("id", "cluster", "weight", "group", F.coalesce(tile, F.lit(0)).alias("tile"))


def pairs_of_tiles(tiled: DataFrame, num: int, den: int) -> DataFrame:
    """cluster, tile, low, high, second: where a tile goes, and its n documents and their weight; pairs of tiles whose sizes are too far apart are left out."""
    tiles = tiled.groupBy("cluster", "tile").agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.sum("weight").alias("weight"), F.count("*").alias("n"))
    one, two = (tiles.select("cluster", *(F.col(c).alias(f"{c}_{k}") for c in ("tile", "least", "most", "weight", "n"))) for k in "ab")
    both = one.join(two, "cluster").where("tile_a <= tile_b").where((F.col("least_b") * num <= F.col("most_a") * den) & (F.col("least_a") * num <= F.col("most_b") * den))
    side = lambda k: both.select("cluster", F.col(f"tile_{k}").alias("tile"), F.col("tile_a").alias("low"), F.col("tile_b").alias("high"), F.lit(k == "b").alias("second"), F.col(f"weight_{k}").alias("weight"), F.col(f"n_{k}").alias("n"))
    return side("a").unionByName(side("b").where("low < high"))


def tile_links(ids: np.ndarray, sizes: np.ndarray, cut: np.ndarray, second: np.ndarray, counts: np.ndarray, hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a tile's documents (second: false) and another's, or within one tile.

    A row is one cut of one document with ``counts`` of ``hashes``.
    """
    names, row = np.unique(ids, return_inverse=True)
    size, side = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    size[row], side[row] = sizes, second
    x, y = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(names)),) * 2
    at_x, at_y = np.full(len(names), -1), np.full(len(names), -1)
    at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
    overlap = np.zeros(len(x) * len(y), np.int32)
    of, cut_of = np.repeat(row, counts), np.repeat(cut, counts)
    for c in range(CUTS):
        here = cut_of == c
        order = np.argsort(hashes[here])
        document, h = of[here][order], hashes[here][order]
        at = _runs(h)
        n = np.diff(np.append(at, len(h)))
        # shingles of few documents: their pairs; of more: products of rows of marks
        few = np.flatnonzero((n > 1) & (n <= FEW))
        for k in range(0, len(few), PAIRS_AT_ONCE // FEW**2):
            m = n[few[k : k + PAIRS_AT_ONCE // FEW**2]]
            begin = at[few[k : k + PAIRS_AT_ONCE // FEW**2]]
            i = np.repeat(document[np.repeat(begin, m) + ranges(m)], np.repeat(m, m))
            j = document[np.repeat(begin, m * m) + ranges(np.repeat(m, m))]
            i, j = at_x[i], at_y[j]
            use = (i >= 0) & (j >= 0)
            overlap += np.bincount(i[use] * len(y) + j[use], minlength=len(overlap)).astype(np.int32)
        many = np.flatnonzero(n > FEW)
        for k in range(0, len(many), 2048):
            m = n[many[k : k + 2048]]
            marks = np.zeros((len(names), len(m)), np.float32)
            marks[document[np.repeat(at[many[k : k + 2048]], m) + ranges(m)], np.repeat(np.arange(len(m)), m)] = 1
            overlap += (marks[x] @ marks[y].T).astype(np.int32).ravel()
    overlap = overlap.reshape(len(x), len(y))
    i, j = np.nonzero((num + den) * overlap.astype(np.int64) >= num * (size[x][:, None] + size[y][None, :]))
    i, j = x[i], y[j]
    label = forest(i[i != j], j[i != j], len(names))
    linked = label != np.arange(len(names))
    return names[label[linked]], names[linked]


def jaccard_components(docs: DataFrame, n: int, num: int, den: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    join = _Join(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")), n, num, den)
    sets = join.sets()
    full = sets.where("n_shingles > 0 and doc_id is not null")
    labels = materialize(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("label"), F.count("*").alias("n")), "jaccard-classes")
    heads = labels.select(F.col("label").alias("id")).distinct()
    shingles = full.join(heads, full["doc_id"] == heads["id"], "left_semi").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    join.room = max(ROUND_BYTES, int(ROUND_SHARE * shingles))
    edges = join.trees(join.of(heads), shingles)

    first = materialize(edges.groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"), "jaccard-first")
    links = join.linked(join.possible(first))
    groups = materialize(components(links), "jaccard-groups", first)
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    both = edges.join(of("id"), "id", "left").join(of("leader"), "leader", "left")
    # a tree holds several components if and only if one of its documents is in another than its leader
    open_ = materialize(both.where(F.coalesce("id_group", "id") != F.coalesce("leader_group", "leader")).select("leader").distinct(), "jaccard-open")
    # with a slice's leader goes the one above it, and with that one all leaders below
    above = edges.join(open_.select(F.col("leader").alias("id")), "id", "left_semi").select("leader")
    tops = open_.union(above).distinct()
    below = edges.join(tops, "leader", "left_semi").select(F.col("id").alias("leader"))
    left = materialize(edges.join(tops.union(below).distinct(), "leader", "left_semi"), "jaccard-left", open_)
    discard(edges)
    if not left.isEmpty():
        links = links.unionByName(join.linked_in_clusters(left, full, groups))
    discard(groups)
    groups = components(links)
    node = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("own"))
    # classes of several documents, each as often as its documents are dealt to tasks
    several = labels.where("n > 1").join(groups, labels["label"] == groups["node"], "left").select("h1", "h2", F.coalesce("component", "label").alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))).alias("salt"))
    salted = full.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(CLASS_SALTS)).cast("int"))
    classes = salted.join(several, ["h1", "h2", "salt"], "left").join(node, "doc_id", "left")
    alone = sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return classes.select("doc_id", "n_shingles", F.coalesce("shared", "own", "doc_id").alias("component_id")).unionByName(alone)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"), 3, 90, 100)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT rid, unnest(w) AS a, generate_subscripts(w, 1) AS pos, len(w) AS words FROM d),
t3 AS (SELECT rid, pos, words, a, lead(a, 1) OVER (PARTITION BY rid ORDER BY pos) AS b, lead(a, 2) OVER (PARTITION BY rid ORDER BY pos) AS c FROM t),
g AS (SELECT DISTINCT rid, concat_ws(' ', a, b, c) AS h FROM t3 WHERE c IS NOT NULL OR (pos = 1 AND words < 3)),
n AS (SELECT d.rid, doc_id, count(h) AS n FROM d LEFT JOIN g ON g.rid = d.rid GROUP BY d.rid, doc_id),
e AS (SELECT rid, h FROM g JOIN n USING (rid) WHERE doc_id IS NOT NULL),
links AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS both_have FROM e x JOIN e y ON x.h = y.h AND x.rid <> y.rid GROUP BY x.rid, y.rid)
    JOIN n AS na ON na.rid = a JOIN n AS nb ON nb.rid = b WHERE 100 * both_have >= 90 * (na.n + nb.n - both_have)),
reach(rid, low) AS (SELECT rid, doc_id FROM n UNION SELECT b, low FROM reach JOIN links ON a = rid)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(low) AS component_id FROM n JOIN reach USING (rid) GROUP BY rid, doc_id
"""
