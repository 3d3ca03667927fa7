"""Language-model scoring with a log-frequency Bloom filter (operator 5).

Tokens are a text's words, A-Z lower-cased, and one end. The model interpolates a bigram with a unigram estimate; all
its counts come from one filter, which lies in segments.

1. Words are counted exactly (summed in slices, then by Spark): N tokens, V distinct ones.
2. The filter lies in segments, ranges of hashes, whose number grows with the input, so that none outgrows a task. Texts send
   each of their distinct words and bigrams to its segment, by hash, with how often training texts have it, once for some MB of text.
3. A segment sums its counts, leaves out bigrams seen fewer than ``min_count`` times (none, unless asked to), and puts the rest into its part of
   the filter. Counts are quantised: level q stands for counts from 2^(q-1) up to 2^q - 1. The
   filter holds (n-gram, 1) to (n-gram, q); asking for level after level until one is missing gives the count back, at
   worst too high where bits collide.
4. A filter that is sure to take at most ``most_broadcast`` bytes (by the number of training tokens) is broadcast, and the tasks that
   score texts probe it. A larger one isn't: slices of texts then get the levels of what they sent, from the segment that
   has just built its part and probes it. Both ways ask the same bits and give the same scores.
5. Scoring: p(w | v) = mix * min(1, c(v w) / c(v)) + (1 - mix) * (c(w) + 0.5) / (N + 0.5 (V + 1)).

The base score needs exact counts of all words. The ``most_frequent`` words (a fixed number) are broadcast; documents
list those of their other words that the filter holds, which are joined with the counts. Words that it does not hold were
never seen in training, as a Bloom filter misses nothing. Words that many documents list are dealt to several tasks.

Defined cases: a null or empty text has the end alone; a text of any length is scored whole; a null doc_id is not held out, but nothing is learned from it;
rows are scored each for itself, equal ones alike; without training documents all counts are 0; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialize
from .quality import fold
from .skew import spread_join
from .words import SPACE_WORDS, Words, mix64, of_six_bytes, pieces, segments_of, six_bytes, tasks_for

FOLDS, HELD_OUT = 5, 1
MOST_FREQUENT, MOST_BROADCAST, BITS_PER_ENTRY, MIN_COUNT, MIX = 200_000, 16 << 20, 10, 1, 0.3
PROBES, BLOCK_BITS, SLICE_BYTES, LEVELS = 4, 512, 2 << 20, 48
#: Training tokens a segment, on the average, and distinct n-grams of a piece of text that a task holds before it sends them.
SEGMENT_TOKENS, MOST_HELD = 600_000, 4_000_000
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, others array<string>, often array<long>"
END, BEGIN = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)  # hashes of the end and of what stands before the first word
END_WORD = ""  # words are never empty


class Tokens:
    """Hashes of all tokens of some texts, the end of each included, and of the bigrams that end in them."""

    def __init__(self, column: pa.Array) -> None:
        words = Words(column, SPACE_WORDS, lower=True)
        self.words, n = words, len(words.counts)
        self.text_of = np.repeat(np.arange(n), words.counts + 1)
        self.number = np.full(len(self.text_of), -1)  # the word's, -1 for an end
        inner = np.ones(len(self.text_of), bool)
        inner[np.cumsum(words.counts + 1) - 1] = False
        self.number[inner] = np.arange(len(words.start))
        self.hash = np.full(len(self.text_of), END)
        self.hash[inner] = words.hashes()
        self.before = np.append(BEGIN, self.hash[:-1]) if n else self.hash
        self.before[np.cumsum(words.counts + 1) - words.counts - 1] = BEGIN

    def bigrams(self) -> np.ndarray:
        return bigram(self.before, self.hash)


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * np.uint64(0x9E3779B97F4A7C15) + w) | np.uint64(1)  # odd: bigrams


def keys(h: np.ndarray) -> np.ndarray:
    """The first 47 bits of a hash and, as the 48th, whether it is a bigram's; this much is sent."""
    return h >> np.uint64(17) << np.uint64(17) | (h & np.uint64(1)) << np.uint64(16)


def unigram(w: np.ndarray) -> np.ndarray:
    return mix64(w) & ~np.uint64(1)  # even: words


def level(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1


def count_of(q: np.ndarray) -> np.ndarray:
    """The middle of the counts of level q; 0 for none."""
    return np.where(q > 0, (np.exp2(q - 1) + np.exp2(q) - 1) / 2, 0.0)


def word_counts(train: DataFrame) -> DataFrame:
    """word, n. The end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            t = Tokens(batch.column(0))
            _, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            number = t.number[first]
            names = [END_WORD if i < 0 else t.words.word(i).decode() for i in number.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["word", "n"])

    return train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed_slices(docs: DataFrame) -> DataFrame:
    """slice, payload: the rows of ``docs`` (doc_id, text, held_out, learn) in compressed slices, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["payload"])

    packed = docs.select("doc_id", "text", "held_out", "learn").mapInArrow(run, "payload binary")
    return materialize(packed.select(F.monotonically_increasing_id().alias("slice"), "payload"), "lm-slices")


def unpacked(payload: pa.BinaryScalar) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(payload.as_buffer())))


def _packed(h: np.ndarray, n: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Segment, number of entries and packed entries (hashes, then counts) of each segment that sorted keys fall into."""
    segment, first = segments_of(h, segments)
    ends = np.append(first[1:], len(h))
    six, n = six_bytes(h), n.astype("<u4")
    out = [six[a:b].tobytes() + (n[a:b] if (n[a:b] > 255).any() else n[a:b].astype(np.uint8)).tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return segment, ends - first, out


def filter_parts(train: DataFrame, segments: int, min_count: int, bits_per_entry: int) -> DataFrame:
    """segment and bits: the parts of the filter that hold anything, of the texts of ``train``, written out."""
    partitions = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, of = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(of, np.concatenate([x for _, x in held]), len(h)).astype(np.int64)
            segment, entries, packed = _packed(h, n, segments)
            return pa.RecordBatch.from_arrays([pa.array(segment), pa.array(entries, pa.int32()), pa.array(packed, pa.binary())], ["segment", "entries", "packed"])

        for batch in pieces(batches, "text", SLICE_BYTES):
            t = Tokens(batch.column(0))
            held.append(np.unique(keys(np.concatenate([unigram(t.hash), t.bigrams()])), return_counts=True))
            size += len(held[-1][0])
            if size >= MOST_HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, hashes, counts = None, [], []

        def flush() -> pa.RecordBatch:
            h, of = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(of, np.concatenate(counts), len(h)).astype(np.int64)
            n[(h >> np.uint64(16) & np.uint64(1) == 1) & (n < min_count)] = 0
            made = segment_filter(h[n > 0], n[n > 0], bits_per_entry)
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([made.bits.tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for s, entries, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != segment and hashes:
                    yield flush()
                    hashes, counts = [], []
                segment = s
                hashes.append(of_six_bytes(packed, entries))
                counts.append(np.frombuffer(packed, "<u4" if len(packed) == 10 * entries else np.uint8, entries, 6 * entries))
        if hashes:
            yield flush()

    sent = train.select("text").mapInArrow(send, "segment long, entries int, packed binary")
    made = sent.repartition(tasks_for(partitions, segments), "segment").sortWithinPartitions("segment").mapInArrow(build, "segment long, bits binary")
    return materialize(made, "lm-filter")


def gram_levels(sliced: DataFrame, segments: int, min_count: int, bits_per_entry: int) -> DataFrame:
    """slice, segment, levels: of each slice's distinct n-grams, in the order of their hashes. ``sliced`` has slice and payload."""
    partitions = int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = unpacked(payload)
                t = Tokens(rows.column("text"))
                learn = rows.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)[t.text_of]
                h, of = np.unique(keys(np.concatenate([unigram(t.hash), t.bigrams()])), return_inverse=True)
                segment, entries, packed = _packed(h, np.bincount(of, np.concatenate([learn, learn]), len(h)), segments)
                columns = [pa.array(np.full(len(segment), at, np.int64)), pa.array(segment), pa.array(entries, pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "segment", "entries", "packed"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, slices, hashes, counts = None, [], [], []

        def flush() -> pa.RecordBatch:
            h, of = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(of, np.concatenate(counts), len(h)).astype(np.int64)
            n[(h >> np.uint64(16) & np.uint64(1) == 1) & (n < min_count)] = 0
            own = segment_filter(h[n > 0], n[n > 0], bits_per_entry)
            levels = own.levels(mix64(h)).astype(np.uint8)[of]
            ends = np.cumsum([len(x) for x in hashes]).tolist()
            parts = [zstandard.compress(levels[a:b].tobytes(), 1) for a, b in zip([0, *ends], ends, strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([segment] * len(slices), pa.int64()), pa.array(parts, pa.binary())], ["slice", "segment", "levels"])

        for batch in batches:
            for at, s, entries, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != segment and hashes:
                    yield flush()
                    slices, hashes, counts = [], [], []
                segment = s
                slices.append(at)
                hashes.append(of_six_bytes(packed, entries))
                counts.append(np.frombuffer(packed, "<u4" if len(packed) == 10 * entries else np.uint8, entries, 6 * entries))
        if hashes:
            yield flush()

    sent = sliced.mapInArrow(send, "slice long, segment long, entries int, packed binary")
    return sent.repartition(tasks_for(partitions, segments), "segment").sortWithinPartitions("segment").mapInArrow(answer, "slice long, segment long, levels binary")


class LogFrequencyFilter:
    """Bits of (n-gram, level) pairs, in blocks of a cache line."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None) -> None:
        self.blocks = blocks
        self.bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8) if bits is None else bits

    def places(self, h: np.ndarray, q: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each n-gram (the same for all levels) and the bits of this level in it."""
        block = self.block_of(h)
        x = mix64(h + (np.asarray(q, np.uint64) << np.uint64(57)) * np.uint64(3) + np.asarray(q, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(9)
        return block, (x[:, None] >> shifts[None, :] & np.uint64(BLOCK_BITS - 1)).astype(np.int64)

    def block_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram: how many levels in a row the filter holds."""
        found, at = np.zeros(len(h), np.int64), np.arange(len(h) if self.blocks else 0)
        for q in range(1, LEVELS):
            block, bit = self.places(h[at], q)
            place = block[:, None] * BLOCK_BITS + bit
            at = at[(self.bits[place >> 3] >> (place & 7) & 1).all(axis=1)]
            if not len(at):
                break
            found[at] = q
        return found


class WholeFilter:
    """All parts of a filter, to be broadcast: it is asked for keys, and each finds its segment's part."""

    def __init__(self, segments: int, parts: Iterator[tuple[int, bytes]]) -> None:
        self.segments, held = segments, dict(parts)
        self.blocks = np.array([8 * len(held.get(k, b"")) // BLOCK_BITS for k in range(segments)], np.int64)
        self.begin = np.append(0, np.cumsum(self.blocks))
        self.bits = np.frombuffer(b"".join(held.get(k, b"") for k in range(segments)), np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each of some sorted keys."""
        found = np.zeros(len(h), np.int64)
        segment, first = segments_of(h, self.segments)
        for s, a, b in zip(segment.tolist(), first.tolist(), [*first[1:].tolist(), len(h)], strict=True):
            if self.blocks[s]:
                low, high = self.begin[s : s + 2] * (BLOCK_BITS // 8)
                found[a:b] = LogFrequencyFilter(int(self.blocks[s]), self.bits[low:high]).levels(mix64(h[a:b]))
        return found


def segment_filter(h: np.ndarray, n: np.ndarray, bits_per_entry: int) -> LogFrequencyFilter:
    """The filter of one segment. Its hashes share their first bits, so it is asked for ``mix64`` of them."""
    q_of = level(n)
    made = LogFrequencyFilter(max(1, -(-int(q_of.sum()) * bits_per_entry // BLOCK_BITS)))
    bits = np.zeros(made.blocks * BLOCK_BITS, bool)
    x = mix64(h)
    for q in range(1, int(q_of.max(initial=0)) + 1):
        block, bit = made.places(x[q_of >= q], q)
        bits[(block[:, None] * BLOCK_BITS + bit).ravel()] = True
    made.bits = np.packbits(bits, bitorder="little")
    return made


def _least_frequent(words: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach."""
    held, least = 0, 1 << 62
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        held += r["words"]
        if held > most:
            break
        least = r["n"]
    return least


class Scorer:
    """Scores of texts from the levels of their n-grams; ``known``: exact counts of the most frequent words."""

    def __init__(self, known: dict[str, int], n_docs: int, norm: float, mix: float) -> None:
        self.known, self.n_docs, self.norm, self.mix = known, n_docs, norm, mix

    def score(self, texts: pa.RecordBatch, levels_of: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        """``levels_of`` is asked once, for the sorted distinct n-grams of the texts."""
        t = Tokens(texts.column("text"))
        n = texts.num_rows
        h, first, word_of = np.unique(t.hash, return_index=True, return_inverse=True)
        number = t.number[first].tolist()
        names = [END_WORD if i < 0 else t.words.word(i).decode() for i in number]
        count = np.array([self.known.get(w, -1) for w in names])
        here = count >= 0
        n_known = np.bincount(t.text_of, here[word_of], n).astype(np.int64)
        pairs, first, pair_of = np.unique(t.bigrams(), return_index=True, return_inverse=True)
        grams = np.unique(keys(np.concatenate([unigram(h), pairs])))
        q = levels_of(grams)
        c_word = count_of(q[np.searchsorted(grams, keys(unigram(h)))])
        never = ~here & (c_word == 0)
        base = np.bincount(t.text_of, np.where(here | never, np.log10(np.maximum(count, 0) + 0.5), 0.0)[word_of], n)
        # words of each text that may have been learned but are none of the most frequent, with how often they stand there
        far = np.flatnonzero((~here & (c_word > 0))[word_of])
        key, times = np.unique(t.text_of[far] * np.int64(len(h)) + word_of[far], return_counts=True)
        owner, which = key // max(1, len(h)), key % max(1, len(h))
        offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
        others = pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(which)))
        often = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))
        # the model
        c_pair = count_of(q[np.searchsorted(grams, keys(pairs))])
        before = t.before[first]
        place = np.minimum(np.searchsorted(h, before), len(h) - 1)
        c_before = np.where(before == BEGIN, float(self.n_docs), c_word[place])
        p_word = np.minimum((c_word + 0.5) / self.norm, 1.0)
        p = self.mix * np.minimum(c_pair / np.maximum(c_before, 1.0), 1.0) + (1 - self.mix) * p_word[word_of[first]]
        model = np.bincount(t.text_of, np.log10(p)[pair_of], n)
        columns = [texts.column("doc_id"), texts.column("held_out"), pa.array(t.words.counts + 1), pa.array(n_known), pa.array(base), pa.array(model), others, often]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORED.split(", ")])


def lm_scores(docs: DataFrame, text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, most_broadcast: int = MOST_BROADCAST, most_frequent: int = MOST_FREQUENT, min_count: int = MIN_COUNT, mix: float = MIX, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    spark = docs.sparkSession
    part = fold(F.col("doc_id"), folds)
    learn = F.coalesce((part != held_out) & F.col("doc_id").isNotNull(), F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.coalesce(part == held_out, F.lit(False)).alias("held_out"), learn.alias("learn"))
    train = docs.where("learn")

    words = materialize(word_counts(train), "lm-words")
    total, distinct, n_docs = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END_WORD, F.col("n"))), F.lit(0))).first()
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // segment_tokens))
    known = {r["word"]: r["n"] for r in words.where(F.col("n") >= _least_frequent(words, most_frequent)).toLocalIterator()}
    norm = total + 0.5 * (distinct + 1)
    scorer = spark.sparkContext.broadcast(Scorer(known, int(n_docs), norm, mix))

    # each training token adds at most one level of a word and one of a bigram
    if 2 * int(total) * BITS_PER_ENTRY // 8 + segments * BLOCK_BITS // 8 <= most_broadcast:
        parts = filter_parts(train, segments, min_count, BITS_PER_ENTRY)
        whole = spark.sparkContext.broadcast(WholeFilter(segments, ((r["segment"], bytes(r["bits"])) for r in parts.toLocalIterator())))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", SLICE_BYTES):
                yield scorer.value.score(batch, whole.value.levels)

        scored = materialize(docs.select("doc_id", "text", "held_out").mapInArrow(probe, SCORED).withColumn("row", F.monotonically_increasing_id()), "lm-scored", parts)
    else:
        sliced = packed_slices(docs)

        def score(slices: pa.Table, levels: pa.Table) -> pa.Table:
            packed = levels.column("levels").take(pc.sort_indices(levels.column("segment"))).to_pylist()
            q = np.frombuffer(b"".join(map(zstandard.decompress, packed)), np.uint8).astype(np.int64)
            return pa.Table.from_batches([scorer.value.score(unpacked(slices.column("payload")[0]), lambda grams: q)])

        levels = gram_levels(sliced, segments, min_count, BITS_PER_ENTRY)
        scored = sliced.groupBy("slice").cogroup(levels.groupBy("slice")).applyInArrow(score, SCORED)
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored", sliced)
    rare = scored.select("row", F.explode(F.arrays_zip("others", "often")).alias("o")).select("row", F.col("o.others").alias("word"), F.col("o.often").alias("often"))
    rare = spread_join(rare, words, ["word"], ["row"], "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("often") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("often"))).alias("more_known"))
    out = scored.drop("others", "often").join(rare, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(norm))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))
