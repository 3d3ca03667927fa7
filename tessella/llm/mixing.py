"""Mixing sources to target weights (operator 9), with DataFrame functions only.

Every source is a stream of words: its documents one after the other, cut into blocks of ``block_words`` words.
The mix is a list of output shards whose slots each take one block.

1. Targets: sources, ordered by code point (null last), weigh 1, 2, 3, 1, ...; they share the sum of all sizes by
   weight, but none gets more than ``max_epochs`` times its own size. The excess is shared anew by weight until no
   target is above its limit. That has a closed form: sources that reach their limit are a prefix of the order by
   size / weight, and the first prefix that leaves every other source below its limit is it.
2. Draws: a source gets as many slots as its target needs blocks of its mean length. How many of them each output shard
   gets is a multinomial draw, given that total: each slot falls on a shard by a hash, and the counts are kept. Prefix sums
   over the shards, in two levels, give each shard its range of the source's slots.
3. Slot i of a source with n blocks takes block permutation(i mod n) in epoch i div n. The permutation is a
   swap-or-not shuffle of 0..n-1: each round pairs x with (key - x) mod n and a hash of the pair says whether to
   swap, which is a bijection for every n and needs no table.
4. Slots join blocks by (source, index). Documents know which words of theirs lie in which block, so the words
   that the mix takes are sums over that join.

Offsets of documents in their source's stream are prefix sums in two levels (chunks of documents, then sums of
chunks), so that no task holds a whole source, however large; slots are made in two levels for the same reason.

``mix_counts`` says how much the mix takes of each document and which shard has its first words, ``mixed_documents`` gives the
documents in that order within each partition, and ``mixed_blocks`` the output shards, slot by slot, with the words of each block.

Defined cases: a null text has no words; documents without words are taken 0 times and have the target of their
source; a null source is a source; equal rows are counted each for itself; a null doc_id sorts first; a text of any
length is cut into as many blocks as it fills; an empty table gives an empty result. Further columns of ``docs`` are ignored
by ``mix_counts`` and pass through ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, materialize
from .columns import Through

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, MAX_EPOCHS, SLOTS_PER_SHARD, SLOTS_PER_ROW, ROUNDS, SEED = 64, 3, 4096, 1 << 13, 12, 20240229


def source_key(source: Column) -> Column:
    """Never null; as text it sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def permuted(x: Column, n: Column, salt: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 applied to x."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(salt, r), n) - at + n, n)
        return F.when(F.pmod(F.xxhash64(salt, r, F.greatest(at, other)), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.array(*(F.lit(i) for i in range(rounds))), x, swap)


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """skey, source_size, target of each source; ``sizes`` has skey and size. One row a source."""
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ordered = by_source.withColumn("weight", ((F.row_number().over(Window.orderBy("skey")) - 1) % 3 + 1).cast("double"))
    limit = max_epochs * F.col("source_size")
    upto = Window.orderBy(F.col("source_size") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ordered.select(
        "*",
        F.coalesce(F.sum(limit).over(upto), F.lit(0)).alias("before"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("weight_left"),
        F.sum("source_size").over(every).alias("all_size"),
    )
    level = (F.col("all_size") - F.col("before")) / F.col("weight_left")  # words per weight if this one and all after it share the rest
    filled = filled.withColumn("level", F.when(limit >= level * F.col("weight"), level))
    filled = filled.withColumn("level", F.first("level", ignorenulls=True).over(Window.orderBy(F.col("source_size") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.least(limit.cast("double"), F.col("level") * F.col("weight"))
    return filled.select("skey", "source_size", F.coalesce(share, limit.cast("double")).alias("target"))


def placed(docs: DataFrame, text: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Documents with skey, size and ``begin`` (words of their source before them), written out; and the targets."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(*keep, source_key(F.col("source")).alias("skey"), size.alias("size"), F.xxhash64(text).alias("text_hash"))
    sized = materialize(sized, "mix-sizes")
    chunks = max(1, round(sized.count() ** 0.5))
    chunk = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks))
    within = Window.partitionBy("skey", "chunk").orderBy("doc_id", "text_hash", "size", *(k for k in keep if k != "doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("chunk", chunk).withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = sized.groupBy("skey", chunk.alias("chunk")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    out = local.join(sums, ["skey", "chunk"]).select(*keep, "skey", "size", "text_hash", (F.col("local") + F.col("offset")).alias("begin"))
    return materialize(out, "mix-placed"), targets(sized)


def draws(quota: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """How many slots each source gets in each output shard: skey, blocks, shard, n and ``first``, its slots in earlier shards.

    Each of a source's slots falls on a shard by a hash, and only the counts stay: a multinomial draw, given the total.
    """
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    facts = quota.where("source_size > 0").select("skey", blocks.alias("blocks"), F.round(F.col("target") * blocks / F.col("source_size")).cast("long").alias("slots"))
    every = F.sum("slots").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    facts = facts.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.floor(every / SLOTS_PER_SHARD))).where("slots > 0")
    runs = facts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOTS_PER_ROW))).alias("run"))
    runs = runs.repartition(int(quota.sparkSession.conf.get("spark.sql.shuffle.partitions")), "skey", "run")
    begin = F.col("run") * SLOTS_PER_ROW
    one = runs.select("skey", "blocks", "shards", F.explode(F.sequence(begin, F.least(begin + SLOTS_PER_ROW, F.col("slots")) - 1)).alias("slot"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "skey", "slot"), F.col("shards"))
    counts = one.groupBy("skey", "blocks", "shards", shard.alias("shard")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("group", F.floor(F.col("shard") / F.ceil(F.sqrt("shards"))))
    within = Window.partitionBy("skey", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("skey").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("skey", "group").agg(F.sum("n").alias("in_group"))
    sums = sums.select("skey", "group", F.coalesce(F.sum("in_group").over(before), F.lit(0)).alias("earlier"))
    counts = counts.withColumn("local", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["skey", "group"])
    return counts.select("skey", "blocks", "shard", "n", (F.col("local") + F.col("earlier")).alias("first"))


def slots(quota: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each slot of the mix: shard, skey, slot, block, epoch. A shard's slots of a source follow those of its earlier shards."""
    drawn = draws(quota, block_words, seed)
    one = drawn.select("shard", "skey", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    return one.select(
        "shard",
        "skey",
        "slot",
        permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), "skey")).alias("block"),
        F.floor(F.col("slot") / F.col("blocks")).alias("epoch"),
    )


def pieces(placed_docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Which words of a document (low to high, without high) lie in which block."""
    b = F.lit(block_words).cast("long")
    end = F.col("begin") + F.col("size")
    blocks = F.sequence(F.floor(F.col("begin") / b), F.floor((end - 1) / b))
    out = placed_docs.where("size > 0").select("*", F.explode(blocks).alias("block"))
    return out.withColumns({"low": F.greatest(F.col("block") * b, "begin") - F.col("begin"), "high": F.least((F.col("block") + 1) * b, end) - F.col("begin")})


def mix_counts(docs: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes) and first_shard (the first that holds any of them) of each document."""
    where, quota = placed(docs, text, "doc_id")
    takes = slots(quota, block_words, seed).groupBy("skey", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"))
    taken = pieces(where, block_words).join(takes, ["skey", "block"], "left")
    words = F.sum((F.col("high") - F.col("low")) * F.coalesce("times", F.lit(0))).cast("long")
    full = taken.groupBy("skey", "begin", "doc_id", "size").agg(words.alias("taken"), F.min("first_shard").alias("first_shard"))
    empty = where.where("size = 0").select("skey", "begin", "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return full.unionByName(empty).join(quota, "skey").select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    """What ``placed`` needs and all columns but the text as one, so that no name can clash; written out with a number a row."""
    number = F.monotonically_increasing_id().cast("string")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    return materialize(docs.select(row.alias("row"), F.col("doc_id"), F.col(f"`{text}`").alias("text"), F.col("source"), number.alias("number")), "mix-rows")


def _words_at(text: Column, spans: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(every, (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))), " ")


def mixed_documents(docs: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as documents: each, once an epoch, with the words that the mix takes from it then, in the order of its first shard.

    Whole documents keep their text as it is; of others the words taken are joined by one space. Columns as in
    ``docs``; ``n_chars`` is set anew where it is there.
    """
    through = Through(docs, "doc_id", text, "source", "n_chars")
    docs, names = through.rows, through.rows.columns
    rows = _numbered(docs, text)
    where, quota = placed(rows, "text", "doc_id", "number")
    # slots come from the few rows of the targets but grow with the mix: they must not be broadcast
    parts = pieces(where, block_words).join(slots(quota, block_words, seed).select("shard", "skey", "block", "epoch").hint("merge"), ["skey", "block"])
    span = F.array_sort(F.collect_list(F.struct("low", "high")))
    epochs = parts.groupBy("number", "size", "epoch").agg(span.alias("spans"), F.sum(F.col("high") - F.col("low")).alias("words"), F.min("shard").alias("shard"))
    out = rows.select("row", "text", "number").join(epochs, "number")
    out = out.withColumn("mixed", F.when(F.col("words") < F.col("size"), _words_at(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    out = out.sortWithinPartitions("shard")
    made = {text: F.col("mixed")} | ({"n_chars": F.length("mixed").cast("long")} if "n_chars" in names else {})
    return through.back(out.select(*(made.get(c, F.col("row").getField(c)).alias(c) for c in names)))


def mixed_blocks(docs: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as output shards: shard, source, slot, epoch and the block's words, joined by one space; partitioned and sorted by shard."""
    rows = _numbered(Through(docs, "doc_id", text, "source").rows, text)
    where, quota = placed(rows, "text", "doc_id", "number")
    cut = rows.select("text", "number").join(pieces(where, block_words).groupBy("number", "skey", "begin").agg(F.array_sort(F.collect_list(F.struct("block", "low", "high"))).alias("cuts")), "number")
    cut = cut.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).select("skey", "begin", "words", F.explode("cuts").alias("cut"))
    piece = F.array_join(F.slice("words", (F.col("cut.low") + 1).cast("int"), (F.col("cut.high") - F.col("cut.low")).cast("int")), " ")
    # a block holds at most block_words words, so its pieces are bounded
    blocks = cut.select("skey", F.col("cut.block").alias("block"), "begin", piece.alias("piece")).groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("begin", "piece"))).alias("pieces"))
    blocks = blocks.select("skey", "block", F.array_join(F.transform("pieces", lambda p: p["piece"]), " ").alias("words"))
    out = slots(quota, block_words, seed).hint("merge").join(blocks, ["skey", "block"])
    source = F.when(F.col("skey") != "t", F.substring("skey", 2, 1 << 30))
    out = out.select("shard", source.alias("source"), "slot", "epoch", "words")
    return out.repartition("shard").sortWithinPartitions("shard", "source", "slot")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
