"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join (operator 10).

A rule ``(action, host, path)`` fits a URL whose host is the rule's host or one of its subdomains and whose
path starts with the rule's path; among fitting rules the longest (host and path together, then host) wins.

1. Rules become canonical keys ``host + path`` and a blocked Bloom filter: each key sets one bit in each of the eight
   64-bit words of one block, so that a probe touches one cache line. Tasks make ranges of blocks of it; where the whole
   would take more than ``max_filter_bytes``, it comes in several parts, each broadcast and probed by itself.
2. Each URL offers its candidates: every host suffix at a dot, times every path prefix of a length that some
   rule has. Candidates that the filter rejects can't be listed.
3. The rest go to an exact hash join on the key, which removes the false positives; keys that many URLs offer are dealt to
   several tasks. The longest rule per distinct URL stays, and a join by URL brings it to the pages, hot URLs dealt too.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; a URL of any length is judged
whole; equal rows stay as often as they came; of rules with the same host and path the one that allows wins; a null rule
host is no rule; an empty table gives an empty result; further columns of ``pages`` pass through, whatever their names,
unless they bear one of the result's (host, path, rule, verdict), whose values replace theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialize
from .columns import Through
from .skew import spread_join
from .words import SPACE_WORDS, Words

#: The list that the registered query judges by: action, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, BLOCK_WORDS, RANGE_BYTES, MAX_FILTER_BYTES = 16, 8, 1 << 20, 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWERED)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_hashes(keys: pa.Array) -> np.ndarray:
    every = np.ones_like(SPACE_WORDS)  # one "word" a key
    return Words(keys, every).hashes()


class BlockedBloom:
    """Blocks ``low`` to ``low + len(words)`` of ``blocks``: ``words[block, 8]``, a key sets one bit in each 64-bit word of its block."""

    def __init__(self, blocks: int, low: int, words: np.ndarray) -> None:
        self.blocks, self.low, self.words = blocks, low, words

    @staticmethod
    def block(h: np.ndarray, blocks: int) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        odd = np.arange(1, 2 * BLOCK_WORDS, 2, dtype=np.uint64) * np.uint64(0x9E3779B1)
        return np.uint64(1) << ((h[:, None] * odd[None, :] >> np.uint64(20)) & np.uint64(63))

    def add(self, h: np.ndarray) -> None:
        block, bits = self.block(h, self.blocks) - self.low, self._bits(h)
        for i in range(BLOCK_WORDS):
            np.bitwise_or.at(self.words[:, i], block, bits[:, i])

    def may_have(self, h: np.ndarray) -> np.ndarray:
        """False only for keys that are not listed; true for all that belong to other blocks."""
        at, out = self.block(h, self.blocks) - self.low, np.ones(len(h), bool)
        mine = np.flatnonzero((at >= 0) & (at < len(self.words)))
        bits = self._bits(h[mine])
        out[mine] = ((self.words[at[mine]] & bits) == bits).all(axis=1)
        return out


def filter_parts(keys: DataFrame, n: int, most_bytes: int) -> Iterator[BlockedBloom]:
    """The filter of ``n`` keys (column key), in parts of at most ``most_bytes``."""
    per_range = max(1, min(RANGE_BYTES, most_bytes) // (8 * BLOCK_WORDS))
    ranges = -(-max(1, -(-n * BITS_PER_KEY // (64 * BLOCK_WORDS))) // per_range)
    blocks = ranges * per_range

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = key_hashes(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(BlockedBloom.block(h, blocks) // per_range), pa.array(h.view(np.int64))], ["range", "hash"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: BlockedBloom | None = None
        for batch in batches:
            at, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for r in np.unique(at).tolist():
                if own is None or own.low != r * per_range:
                    if own is not None:
                        yield _range_row(own, per_range)
                    own = BlockedBloom(blocks, r * per_range, np.zeros((per_range, BLOCK_WORDS), np.uint64))
                own.add(h[at == r])
        if own is not None:
            yield _range_row(own, per_range)

    made = keys.mapInArrow(hashed, "range long, hash long").repartition("range").sortWithinPartitions("range").mapInArrow(fill, "range long, bits binary")
    made = materialize(made, "url-filter")
    per_part = max(1, most_bytes // (per_range * 8 * BLOCK_WORDS))
    for first in range(0, ranges, per_part):
        part = BlockedBloom(blocks, first * per_range, np.zeros((min(per_part, ranges - first) * per_range, BLOCK_WORDS), np.uint64))
        for r in made.where(F.col("range").between(first, first + per_part - 1)).toLocalIterator():
            at = (r["range"] - first) * per_range
            part.words[at : at + per_range] = np.frombuffer(r["bits"], np.uint64).reshape(-1, BLOCK_WORDS)
        yield part


def _range_row(part: BlockedBloom, per_range: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part.low // per_range]), pa.array([part.words.tobytes()], pa.binary())], ["range", "bits"])


def candidates_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that a rule fitting this host and path may have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    heads = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(F.filter(suffixes, lambda e: e != ""), lambda e: F.transform(heads, lambda p: F.concat(e, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (text of the longest that fits, else null) and verdict."""
    spark, through = pages.sparkSession, Through(pages, url)
    pages, kept = through.rows, [c for c, given in through.names.items() if given.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col("url"))
    # columns that pass through travel in one, so that no name can clash
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(True)
    pages = pages.select(row.alias("row"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url")).withColumns({"host": host, "path": path})
    rules = rules.where("host is not null and host <> ''").select("action", "host", F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.min(F.struct("host", "path", "action")).alias("r")).select("key", "r.*")
    facts = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    keys = candidates_of(F.col("host"), F.col("path"), sorted(facts["lengths"]))
    candidates = pages.where("host <> ''").select("url", F.explode(keys).alias("key")) if facts["lengths"] else pages.where("false").select("url", F.col("url").alias("key"))
    parts = 0
    for part in filter_parts(rules.select("key"), facts["n"], max_filter_bytes):
        shared, parts = spark.sparkContext.broadcast(part), parts + 1

        def possible(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(shared.value.may_have(key_hashes(batch.column(1)))))

        candidates = candidates.mapInArrow(possible, "url string, key string")
        if facts["n"] * BITS_PER_KEY // 8 > max_filter_bytes:  # one part at a time in the executors' memory
            candidates = materialize(candidates, "url-candidates")
            shared.unpersist()
    order = F.struct((F.length("host") + F.length("path")).alias("a"), F.length("host").alias("b"), "key", "action")
    fits = spread_join(candidates.distinct(), rules, ["key"], ["url"]).groupBy("url").agg(F.max(order).alias("best"))
    out = spread_join(pages.withColumn("place", F.monotonically_increasing_id()), fits, ["url"], ["place"], "left", counted=pages.select("url"))
    return through.back(out.select(*([F.col("row.*")] if kept else []), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "action string, host string, path string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark)).drop("url")


SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
        coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        row_number() OVER () AS row_id FROM u),
rules(action, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
        ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (SELECT row_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(action, length(rule_host || rule_path)) AS action
    FROM p JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best USING (row_id)
"""
