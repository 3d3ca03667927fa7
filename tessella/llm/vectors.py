"""Embedding near-dedup by PCA-ordered tiled comparison (operator 8).

Two vectors link when their cosine, in double precision, is at least ``threshold``.

1. Equal vectors (by 128 bits of hashes) are one class, which counts as often as it has members: from here on one vector a
   class is compared, so copies cost nothing but a sum.
2. Unit vectors are turned into their principal axes (the second moments of all classes, summed where the rows lie;
   the turn keeps every product). Blocks are ranges of the first coordinate, cut at its quantiles; a range with more
   rows than a block holds, because they share that coordinate, is dealt to several blocks by hash.
3. |u - v|^2 = 2 - 2 cos, so linked vectors differ by at most sqrt(2 - 2 threshold) in each coordinate: pairs of
   blocks, and of tiles within them, that lie farther apart are not compared.
4. A tile of one block is compared with a tile of the other by matrix products over the leading coordinates first.
   What the others can add is at most the product of the norms of the suffixes; pairs that can't reach the
   threshold stop there, and the rest go on to the next coordinates. Products within 1e-9 of the threshold are
   taken anew from the vectors as given.
5. A task reports, for its two blocks, how many links each vector has and a spanning forest of them, at most one row a
   vector each, never the pairs themselves. Sums and components of these are those of all links.

Vectors travel as given (single precision stays single) and become doubles in the tasks. A vector is sent once for each
block within reach, so what is sent grows with the number of vectors times that of blocks of ``block_rows``.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components link
with nothing; equal vectors link; rows with equal or null vec_ids are vectors of their own; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import load, materialize
from .graph import components, forest
from .skew import spread_join
from .words import mix64

THRESHOLD, BLOCK_ROWS, TILE_ROWS, STAGES = 0.95, 16384, 1024, (16, 32)
NEAR = 1e-9


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision; the rows hold valid vectors of this length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    largest = np.abs(x).max(axis=1, keepdims=True)
    x = x / largest  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            u = unit_rows(batch.column(0), dim)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["at", "value"])

    rows = vectors.select("v").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(dim * dim)
    for r in rows:
        out[r["at"]] = r["value"]
    return out.reshape(dim, dim)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, product) of all pairs that reach ``threshold - NEAR``; leading coordinates first."""
    dim = a.shape[1]
    stops = [s for s in STAGES if s < dim] + [dim]
    product = a[:, : stops[0]] @ b[:, : stops[0]].T
    rest_a, rest_b = (np.sqrt((x[:, stops[0] :] ** 2).sum(axis=1)) for x in (a, b))
    i, j = np.nonzero(product + rest_a[:, None] * rest_b[None, :] >= threshold - NEAR)
    value = product[i, j]
    for low, high in zip(stops[:-1], stops[1:], strict=True):
        if not len(i):
            break
        if len(i) > 0.05 * product.size:  # most of the tile goes on: one more matrix product
            product = a[:, :high] @ b[:, :high].T
            value = product[i, j]
        else:
            value = value + np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 100_000], low:high], b[j[k : k + 100_000], low:high]) for k in range(0, len(i), 100_000)])
        rest_a, rest_b = (np.sqrt((x[:, high:] ** 2).sum(axis=1)) for x in (a, b))
        stay = value + rest_a[i] * rest_b[j] >= threshold - NEAR
        i, j, value = i[stay], j[stay], value[stay]
    return i, j, value


def block_links(side: np.ndarray, times: np.ndarray, v: np.ndarray, turned: np.ndarray, threshold: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row, smallest row that it reaches) within a block (one side), or between two blocks; row k counts ``times[k]`` times."""
    order = np.lexsort((turned[:, 0], side))
    sides = side[order]
    cut = int(np.searchsorted(sides, 1))
    n = len(side)
    degree, parent = np.zeros(n, np.int64), np.arange(n)
    left = [order[k : min(k + TILE_ROWS, cut)] for k in range(0, cut, TILE_ROWS)]
    right = [order[k : k + TILE_ROWS] for k in range(cut, n, TILE_ROWS)]
    pairs = [(x, y) for x in left for y in right] if right else [(left[p], left[q]) for p in range(len(left)) for q in range(p, len(left))]
    for x, y in pairs:
        ax, ay = turned[x], turned[y]
        if ay[0, 0] - ax[-1, 0] > reach or ax[0, 0] - ay[-1, 0] > reach:
            continue
        i, j, value = tile_links(ax, ay, threshold)
        if x is y:
            upper = i < j
            i, j, value = i[upper], j[upper], value[upper]
        close = np.abs(value - threshold) <= NEAR
        if close.any():
            value[close] = np.einsum("ij,ij->i", v[x[i[close]]], v[y[j[close]]])
        sure = value >= threshold
        i, j = x[i[sure]], y[j[sure]]
        if len(i):
            degree += (np.bincount(i, times[j], n) + np.bincount(j, times[i], n)).astype(np.int64)
            new = parent[i] != parent[j]
            if new.any():
                own = forest(np.concatenate([i[new], np.arange(n)]), np.concatenate([j[new], parent]), n)
                parent = own
    return degree, parent


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    given = vectors.schema[column].dataType
    kind = "float" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "double"
    v = F.col(f"`{column}`").cast(f"array<{kind}>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("uid"))
    rows = materialize(rows, "vectors")
    sizes = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 0
    fine = F.col("v").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    members = rows.where(fine).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = members.groupBy("h1", "h2").agg(F.min("uid").alias("uid"), F.count("*").alias("times"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = materialize(classes, f"vector-classes-{kind}")
    found = _links(classes, dim, threshold, block_rows, kind)
    if found is None:
        judged = classes.select("h1", "h2", (F.col("times") - 1).alias("n_links"), F.col("least").alias("component_id"))
    else:
        degrees = found.groupBy("uid").agg(F.sum("degree").alias("degree"))
        groups = components(found.where("uid <> parent").select(F.col("parent").alias("a"), F.col("uid").alias("b"))).withColumnRenamed("node", "uid")
        both = classes.drop("v").join(degrees, "uid", "left").join(groups, "uid", "left")
        both = materialize(both.select("h1", "h2", (F.coalesce("degree", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least", F.coalesce("component", "uid").alias("component")), "vector-groups", found)
        heads = both.groupBy("component").agg(F.min("least").alias("component_id"))
        judged = spread_join(both, heads, ["component"], ["h1"]).select("h1", "h2", "n_links", "component_id")
    out = spread_join(members.select("vec_id", "uid", "h1", "h2"), judged, ["h1", "h2"], ["uid"]).select("vec_id", "n_links", "component_id")
    others = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(classes: DataFrame, dim: int, threshold: float, block_rows: int, kind: str) -> DataFrame | None:
    """uid, degree, parent from every compared pair of blocks (rows without links left out); ``classes``: uid, times and v."""
    spark = classes.sparkSession
    n = classes.count()
    if n < 2:
        return None
    values, axes = np.linalg.eigh(second_moments(classes, dim))
    axes = axes[:, np.argsort(-values)]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + NEAR
    blocks = -(-n // block_rows)

    def lead(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unit_rows(batch.column(0), dim) @ axes[:, 0])], ["lead"])

    cuts = np.array([-np.inf])
    if blocks > 1:
        leads = classes.select("v").mapInArrow(lead, "lead double")
        cuts = np.append(cuts, np.unique(leads.select(F.percentile_approx("lead", [k / blocks for k in range(1, blocks)], 100 * blocks)).first()[0]))
        in_range = leads.mapInArrow(lambda batches: _counts(batches, cuts), "range long, n long").groupBy("range").agg(F.sum("n").alias("n"))
        held = {r["range"]: r["n"] for r in in_range.collect()}
    else:
        held = {0: n}
    # a range of one coordinate that many rows share makes several blocks; those of a range have neighbouring numbers
    shares = np.array([max(1, -(-held.get(k, 0) // block_rows)) for k in range(len(cuts))])
    begin = np.append(0, np.cumsum(shares))
    ends = np.append(cuts[1:], np.inf)
    first = begin[np.searchsorted(ends, cuts - reach, side="left")]
    last = begin[np.searchsorted(cuts, ends + reach, side="right")] - 1

    def place(batches):
        for batch in batches:
            uid, u = batch.column(0).to_numpy(), unit_rows(batch.column(2), dim)
            at = np.searchsorted(cuts, u @ axes[:, 0], side="right") - 1
            block = begin[at] + (mix64(uid.view(np.uint64)) % shares[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int32)) for x in (block, first[at], last[at]))], ["uid", "times", "v", "block", "first", "last"])

    placed = classes.select("uid", "times", "v").mapInArrow(place, f"uid long, times long, v array<{kind}>, block int, first int, last int")
    sent = placed.select("uid", "times", "v", "block", F.explode(F.sequence("first", "last")).alias("other"))
    sent = sent.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"), "uid", "times", "v")

    def compare(table: pa.Table) -> pa.Table:
        uid, side, times = (table.column(c).to_numpy() for c in ("uid", "side", "times"))
        v = unit_rows(table.column("v").combine_chunks(), dim)
        degree, parent = block_links(side, times, v, v @ axes, threshold, reach)
        linked = degree > 0
        return pa.table([pa.array(uid[linked]), pa.array(degree[linked]), pa.array(uid[parent[linked]])], ["uid", "degree", "parent"])

    total = int(begin[-1])
    sent = sent.repartition(min(total * (total + 1) // 2, 20_000), "low", "high")
    return materialize(sent.groupBy("low", "high").applyInArrow(compare, "uid long, degree long, parent long"), "vector-links")


def _counts(batches, cuts: np.ndarray):
    total = np.zeros(len(cuts), np.int64)
    for batch in batches:
        total += np.bincount(np.searchsorted(cuts, batch.column(0).to_numpy(), side="right") - 1, minlength=len(cuts))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array(total)], ["range", "n"])


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_components(load(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT rid, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.rid AS a, b.rid AS b FROM fine a JOIN fine b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
degrees AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a),
reach(rid, low) AS (SELECT rid, vec_id FROM v UNION SELECT b, low FROM reach JOIN links ON a = rid),
least AS (SELECT rid, min(low) AS component_id FROM reach GROUP BY rid)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN least USING (rid) LEFT JOIN degrees USING (rid)
"""
