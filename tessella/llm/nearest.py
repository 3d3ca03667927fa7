"""Exact top-k search by a Voronoi kNN join (operator 12).

Components become floor(256 x) and a score is the inner product of two such vectors, a whole number. A score is
|q| |d| cos of the angle between them, and angles obey the triangle inequality, so the cells are those of directions.
Only vectors of one length have a score, so each length has cells of its own.

1. Pivots are a bounded sample of the queries of each length. Queries and data belong to the pivot of the smallest angle.
2. Summaries: of each query cell its largest angle to the pivot and its norms; of each data cell its largest angle and norm; and,
   for each query cell, the ``k`` + 1 best scores that rows of the data are sure to reach with every query of the cell (the angle is
   at most that to the pivot plus the cell's). The last of these bounds the k-th score of the cell's queries from below, even if
   the query itself is among them.
3. A data cell whose largest possible score with a query cell is below that bound is of no use there; of the others each row
   is judged by its own angle to the pivot. What remains is replicated to the query cell, nothing else.
4. A cell's rows are dealt to chunks of ``chunk_rows`` and its queries to parts of ``part_rows``; each (cell, part, chunk) is solved by
   matrix products, exact in doubles or else in whole numbers, and returns each query's k best. The k best of these are the result.
   Where products may leave 64 bits they are taken modulo 2^64, and doubles with their error bounds tell which of them fit.

Of equal vectors only the k + 1 rows that go first can be in any result, so the others stay behind before anything is
replicated; a vector that many rows share costs no more than one. Bounds leave a margin for rounding, so they
never cost a row. Where directions are spread evenly bounds separate little, and each row goes to most of the query cells.

Defined cases: vectors that are null or hold null or non-finite components (256 x included) take no part; all others do, whatever
their length and size, zero and empty ones too. A pair whose score leaves 64 bits has none, as no long holds it: the query's other
pairs stay. A query is each row of its own, whatever its id, and is no candidate for itself alone; rows without an id are candidates
that come last among equal scores, and no queries; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, materialize

K, EVERY, MOST_PIVOTS, CELL_QUERIES, PART_ROWS, CHUNK_ROWS, TILE_ROWS = 5, 50, 512, 1024, 4096, 16384, 1024
#: What rounding may cost a cosine.
SLACK = 1e-6
#: Scores below fit 64 bits, whatever rounding did to them; norms beyond FAR count as FAR, as their scores hardly fit.
FITS, FAR = 2.0**62, 2.0**100


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of rows, and the rows at norm 1 (zero stays zero)."""
    largest = np.abs(v).max(axis=1, initial=0)
    v = v / np.where(largest > 0, largest, 1)[:, None]  # no overflow in the squares
    norm = np.sqrt((v * v).sum(axis=1))
    return np.minimum(largest, FAR) * norm, v / np.where(norm > 0, norm, 1)[:, None]


def _angles(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of rows, and their angles to unit pivots; a zero vector is at a right angle to all."""
    norm, unit = _units(v)
    return norm, np.arccos(np.clip(unit @ pivots.T, -1, 1))


class Cells:
    """Pivots of one length, and the summaries of their query cells and data cells as far as they are known; ``first``: the number of the first cell."""

    def __init__(self, pivots: np.ndarray, first: int = 0) -> None:
        self.first, self.pivots = first, _units(pivots)[1]
        n = len(pivots)
        self.queries, self.angle, self.short, self.long = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
        self.least = np.full(n, -np.inf)
        self.near = np.ones((n, n), bool)

    def lower(self, norm: np.ndarray, angle: np.ndarray) -> np.ndarray:
        """Scores that rows are sure to reach with every query of each cell; none where a score might leave 64 bits."""
        c = np.cos(np.minimum(angle + self.angle, math.pi)) - SLACK
        return np.where(norm[:, None] * self.long < FITS, norm[:, None] * np.where(c >= 0, self.short, self.long) * c, -np.inf)

    def upper(self, norm: np.ndarray, angle: np.ndarray, spread: np.ndarray | float = 0.0) -> np.ndarray:
        """Scores that rows, or cells ``spread`` wide, can't exceed with any query of each cell."""
        c = np.cos(np.maximum(angle - self.angle - spread, 0)) + SLACK
        return norm[:, None] * np.where(c >= 0, self.long, self.short) * c

    def judge(self, widest: np.ndarray, longest: np.ndarray) -> None:
        """near: which query cells (columns) may need rows of which data cells (rows); of rows with a negative bound any norm below the longest does."""
        between = np.arccos(np.clip(self.pivots @ self.pivots.T, -1, 1))
        most = np.maximum(self.upper(longest, between, widest[:, None]), 0)
        self.near = (most >= self.least) & (self.queries > 0)


def _strips(batches: Iterator[pa.RecordBatch], groups: dict[int, Cells]) -> Iterator[tuple[Cells, pa.RecordBatch]]:
    """The rows of each length with the cells of that length; rows of lengths without queries are left out."""
    for batch in batches:
        for k in range(0, batch.num_rows, TILE_ROWS):
            strip = batch.slice(k, TILE_ROWS)
            sizes = pc.list_value_length(strip.column("v")).to_numpy()
            for n in np.unique(sizes):
                if int(n) in groups:
                    yield groups[int(n)], strip if (sizes == n).all() else strip.filter(pa.array(sizes == n))


def assign(batches: Iterator[pa.RecordBatch], groups: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """Each row with its cell, its angle to the pivot and its norm. Columns: uid, vec_id, v."""
    for cells, batch in _strips(batches, groups):
        norm, angle = _angles(_matrix(batch.column("v")), cells.pivots)
        cell = angle.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((cells.first + cell).astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell]), pa.array(norm)], ["uid", "vec_id", "v", "cell", "angle", "norm"])


def summarise(batches: Iterator[pa.RecordBatch], groups: dict[int, Cells], k: int) -> Iterator[pa.RecordBatch]:
    """One row a data cell (angle, norm) and up to k rows a query cell (bound) for all rows of a task. Column: v."""
    held = {}
    for cells, batch in _strips(batches, groups):
        n = len(cells.pivots)
        best, widest, longest = held.get(cells.first) or (np.full((0, n), -np.inf), np.full(n, -1.0), np.zeros(n))
        norm, angle = _angles(_matrix(batch.column("v")), cells.pivots)
        best = np.concatenate([best, cells.lower(norm, angle)])
        if len(best) > k:
            best = np.partition(best, len(best) - k, axis=0)[-k:]
        cell = angle.argmin(axis=1)
        np.maximum.at(widest, cell, angle[np.arange(len(cell)), cell])
        np.maximum.at(longest, cell, norm)
        held[cells.first] = best, widest, longest
    for first, (best, widest, longest) in held.items():
        some = np.flatnonzero(widest >= 0)
        cell = (first + np.concatenate([some, np.tile(np.arange(len(widest)), len(best))])).astype(np.int32)
        nothing = np.full(len(some), np.nan), np.full(best.size, np.nan)
        columns = np.concatenate([nothing[0], best.ravel()]), np.concatenate([widest[some], nothing[1]]), np.concatenate([longest[some], nothing[1]])
        yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(x, from_pandas=True) for x in columns)], ["cell", "bound", "angle", "norm"])


def needed(batches: Iterator[pa.RecordBatch], groups: dict[int, Cells]) -> Iterator[pa.RecordBatch]:
    """Each row with the query cells that may need it. Columns: uid, vec_id, v."""
    for cells, batch in _strips(batches, groups):
        norm, angle = _angles(_matrix(batch.column("v")), cells.pivots)
        useful = cells.near[angle.argmin(axis=1)] & (cells.upper(norm, angle) >= cells.least)
        row, cell = np.nonzero(useful)
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array((cells.first + cell).astype(np.int32)))], ["uid", "vec_id", "v", "cells"])


def _wrapped(x: np.ndarray) -> np.ndarray:
    """Whole doubles modulo 2^64."""
    low = np.fmod(np.abs(x), 2.0**64).astype(np.uint64)
    return np.where(x < 0, -low, low).view(np.int64)


def scores(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Inner products of whole rows, and which of them fit 64 bits (None: all); the others are of no use."""
    dim = q.shape[1]
    most = dim * float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0))
    if most < 1 << 53:
        return (q @ d.T).astype(np.int64), None
    if len(q) > TILE_ROWS:
        parts = [scores(q[k : k + TILE_ROWS], d) for k in range(0, len(q), TILE_ROWS)]
        return np.concatenate([s for s, _ in parts]), np.concatenate([np.ones(s.shape, bool) if f is None else f for s, f in parts])
    score = _wrapped(q) @ _wrapped(d).T
    if most < FITS:
        return score, None
    # rows are brought to components of at most 1 by powers of 2, so that nothing overflows
    up_q, up_d = (np.frexp(np.abs(x).max(axis=1, initial=0))[1] for x in (q, d))
    a, b = np.ldexp(q, -up_q[:, None]), np.ldexp(d, -up_d[:, None])
    about, spare = np.abs(a @ b.T), np.abs(a) @ np.abs(b).T * (dim * 2.0**-51) + 2.0**-1000
    edge = np.ldexp(1.0, 63 - up_q[:, None] - up_d[None, :])
    fits = about + spare < edge
    for i, j in zip(*np.nonzero(~fits & (about - spare <= edge)), strict=True):
        fits[i, j] = -(1 << 63) <= sum(int(x) * int(y) for x, y in zip(q[i], d[j], strict=True)) < 1 << 63
    return score, fits


def solve(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """quid, query_id, vec_id, score: the k best rows for each query, its own row left out; equal scores by vec_id, nulls last."""
    names = ["quid", "query_id", "vec_id", "score"]
    if not queries.num_rows or not rows.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names)
    q, d = _matrix(queries.column("v")), _matrix(rows.column("v"))
    own = dict(zip(rows.column("uid").to_pylist(), range(rows.num_rows), strict=True))
    mine = np.array([own.get(u, -1) for u in queries.column("uid").to_pylist()])
    null = rows.column("vec_id").is_null().to_numpy()
    ids = rows.column("vec_id").fill_null(0).to_numpy()
    held_q, held_d, held_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.full(len(q), np.iinfo(np.int64).min)
    for begin in range(0, len(d), TILE_ROWS):
        tile = d[begin : begin + TILE_ROWS]
        score, fits = scores(q, tile)
        there = np.ones(score.shape, bool) if fits is None else fits
        here = np.flatnonzero((mine >= begin) & (mine < begin + len(tile)))
        there[here, mine[here] - begin] = False
        score[~there] = np.iinfo(np.int64).min
        if len(tile) > k:
            least = np.maximum(least, np.partition(score, len(tile) - k, axis=1)[:, -k])
        i, j = np.nonzero((score >= least[:, None]) & there)
        held_q, held_d, held_s = np.append(held_q, i), np.append(held_d, j + begin), np.append(held_s, score[i, j])
        order = np.lexsort((ids[held_d], null[held_d], -held_s, held_q))
        held_q, held_d, held_s = held_q[order], held_d[order], held_s[order]
        place = np.arange(len(held_q)) - np.searchsorted(held_q, held_q)
        best = place < k
        held_q, held_d, held_s, place = held_q[best], held_d[best], held_s[best], place[best]
        full = place == k - 1
        least[held_q[full]] = np.maximum(least[held_q[full]], held_s[full])
    at = pa.array(held_q)
    return pa.table([queries.column("uid").take(at), queries.column("vec_id").take(at), rows.column("vec_id").take(pa.array(held_d)), pa.array(held_s)], names)


def _solver(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda queries, rows: solve(queries, rows, k)


def _by_cell(values: np.ndarray) -> Column:
    """The entry of a short array for the column ``cell``."""
    return F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("cell") + 1)


def nearest(
    vectors: DataFrame, k: int = K, every: int = EVERY, most_pivots: int = MOST_PIVOTS, cell_queries: int = CELL_QUERIES, part_rows: int = PART_ROWS, chunk_rows: int = CHUNK_ROWS, key: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    v = F.col(f"`{column}`").cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(256 * x) < float("inf")))  # NaN is above every number
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    most = rows.agg(F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))).first()[0]
    if most is None:
        return empty
    kind = "int" if most < 1 << 22 else "double"
    whole = lambda x: F.floor(256 * x).cast(kind) if kind == "int" else F.when(F.abs(x) < 1 << 52, F.floor(256 * x).cast(kind)).otherwise(256 * x)
    rows = materialize(rows.withColumn("v", F.transform("v", whole)), "nearest-rows")
    queries = rows.where(F.col("vec_id") % every == 0)
    sized = queries.withColumn("n", F.size("v"))
    shares = sized.groupBy("n").agg(F.greatest(F.lit(1), F.least(F.lit(most_pivots), F.floor(F.count("*") / cell_queries))).alias("share"))
    sampled = sized.withColumn("place", F.row_number().over(Window.partitionBy("n").orderBy(F.xxhash64("uid"), "uid"))).where(F.col("place") <= max(1, most_pivots))
    pivots = {}
    for r in sampled.join(F.broadcast(shares), "n").where("place <= share").collect():
        pivots.setdefault(r["n"], []).append(r["v"])
    if not pivots:
        return empty
    groups, total = {}, 0
    for n, held in sorted(pivots.items()):
        groups[n] = Cells(np.array(held, np.float64).reshape(len(held), n), total)
        total += len(held)
    of = [c for c in groups.values() for _ in c.pivots]
    row = f"uid long, vec_id long, v array<{kind}>"
    shared = spark.sparkContext.broadcast(groups)
    placed = queries.select("uid", "vec_id", "v").mapInArrow(lambda batches: assign(batches, shared.value), f"{row}, cell int, angle double, norm double")
    placed = materialize(placed, "nearest-queries")
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.min("norm").alias("short"), F.max("norm").alias("long"))
    for r in summary.collect():
        cells = of[r["cell"]]
        at = r["cell"] - cells.first
        cells.queries[at], cells.angle[at], cells.short[at], cells.long[at] = r["n"], r["angle"], r["short"], r["long"]
    first = Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "uid")
    data = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select("uid", "vec_id", "v")
    data = materialize(data, "nearest-data")
    known = spark.sparkContext.broadcast(groups)
    facts = data.select("v").mapInArrow(lambda batches: summarise(batches, known.value, k + 1), "cell int, bound double, angle double, norm double")
    facts = materialize(facts, "nearest-summaries")
    widest, longest = np.zeros(total), np.zeros(total)
    for r in facts.where("angle is not null").groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect():
        widest[r["cell"]], longest[r["cell"]] = r["angle"], r["norm"]
    best = Window.partitionBy("cell").orderBy(F.desc("bound"))
    for r in facts.where("bound is not null").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).where(F.col("place") == k + 1).collect():
        of[r["cell"]].least[r["cell"] - of[r["cell"]].first] = r["bound"]
    for cells in groups.values():
        own = slice(cells.first, cells.first + len(cells.pivots))
        cells.judge(widest[own], longest[own])
    judged = spark.sparkContext.broadcast(groups)
    sent = materialize(data.mapInArrow(lambda batches: needed(batches, judged.value), f"{row}, cells array<int>"), "nearest-needed", data, facts)
    sent = sent.select("uid", "vec_id", "v", F.explode("cells").alias("cell"))
    counts = np.zeros(total, np.int64)
    for r in sent.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    chunks, parts = _by_cell(-(-counts // chunk_rows)), _by_cell(-(-np.concatenate([c.queries for c in groups.values()]) // part_rows))
    upto = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    left = placed.select("uid", "vec_id", "v", "cell", F.pmod(F.xxhash64("uid"), parts).cast("int").alias("part"), chunks.alias("chunks")).where("chunks > 0")
    left = left.select("uid", "vec_id", "v", "cell", "part", upto(F.col("chunks")).alias("chunk"))
    right = sent.select("uid", "vec_id", "v", "cell", F.pmod(F.xxhash64(F.lit(1), "uid"), chunks).cast("int").alias("chunk"), upto(parts).alias("part"))
    keys = ("cell", "part", "chunk")  # ints on both sides: cogroup casts none, and longs hash elsewhere
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_solver(k), "quid long, query_id long, vec_id long, score long")
    ranks = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.rid <> d.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
