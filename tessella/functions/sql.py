"""Chunk names and grids as SQL functions: ``register`` makes them in a session, after which plain SQL uses them.

Scalars are SQL functions themselves, which Catalyst inlines, and so is ``chunk_axis``, the pieces of one axis as an array for
``LATERAL VIEW inline(...)``: that stays in the JVM. ``chunk_grid``, all chunks of a level by a lateral join, is a Python table
function, as a SQL one can't generate rows from a row of another table; it yields its rows as it makes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegralType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

AXES = "tczyx"


@udtf
class ChunkGrid:
    """chunk_grid(t_size, ..., x_size, t_chunk, ..., x_chunk): numbers, boxes and whether no axis is cut short; nothing for an empty or null axis."""

    @staticmethod
    def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
        if len(given) != 10:
            raise ValueError(f"chunk_grid takes five sizes and five chunk sizes, not {len(given)} values")
        for a, g in zip([*(f"{a}_size" for a in AXES), *(f"{a}_chunk" for a in AXES)], given, strict=True):
            if g.isTable or not isinstance(g.dataType, IntegralType):
                raise ValueError(f"chunk_grid takes whole numbers; {a} is {'a table' if g.isTable else g.dataType.simpleString()}")
            if g.isConstantExpression and g.value is not None and a.endswith("chunk") and g.value < 1:
                raise ValueError(f"chunk_grid takes positive chunk sizes; {a} is {g.value}")
        out = StructType()
        for name in [*(f"c{a}" for a in AXES), *(f"{a}{e}" for a in AXES for e in (0, 1))]:
            out.add(name, LongType(), False)
        return AnalyzeResult(out.add("full", BooleanType(), False))

    def eval(self, *given: int | None) -> Iterator[tuple]:
        if any(v is None or v < 1 for v in given):
            return
        pieces = [[(i, i * k, min((i + 1) * k, n), (i + 1) * k <= n) for i in range(-(-n // k))] for n, k in zip(given[:5], given[5:], strict=True)]
        for chunk in product(*pieces):
            yield (*(p[0] for p in chunk), *(bound for p in chunk for bound in p[1:3]), all(p[3] for p in chunk))


def definitions() -> dict[str, str]:
    """Name and CREATE statement of each SQL function."""
    numbers = ", ".join(f"c{a} BIGINT" for a in AXES)
    places = ", ".join(f"'c{a}', cast(split_part(name, '.', {i + 1}) AS BIGINT)" for i, a in enumerate(AXES))
    bounds = ", ".join(f"'{a}{e}', cast(split_part(split_part(name, '_', {i + 1}), '-', {e + 1}) AS BIGINT)" for i, a in enumerate("xyz") for e in (0, 1))
    made = {
        "chunk_axis(n BIGINT, k BIGINT)": ("ARRAY<STRUCT<number: BIGINT, low: BIGINT, high: BIGINT>>", "CASE WHEN n > 0 AND k > 0 THEN transform(sequence(0L, (n - 1) DIV k), i -> named_struct('number', i, 'low', i * k, 'high', least((i + 1) * k, n))) ELSE array() END"),
        f"chunk_name({numbers})": ("STRING", f"concat_ws('.', {', '.join(f'cast(c{a} AS STRING)' for a in AXES)})"),
        "chunk_of_name(name STRING)": ("STRUCT<ct: BIGINT, cc: BIGINT, cz: BIGINT, cy: BIGINT, cx: BIGINT>", f"named_struct({places})"),
        "box_name(z0 BIGINT, z1 BIGINT, y0 BIGINT, y1 BIGINT, x0 BIGINT, x1 BIGINT)": ("STRING", "concat(x0, '-', x1, '_', y0, '-', y1, '_', z0, '-', z1)"),
        "box_of_name(name STRING)": ("STRUCT<x0: BIGINT, x1: BIGINT, y0: BIGINT, y1: BIGINT, z0: BIGINT, z1: BIGINT>", f"named_struct({bounds})"),
        "halo_box(low BIGINT, high BIGINT, n BIGINT, width BIGINT)": ("STRUCT<low: BIGINT, high: BIGINT, before: BIGINT, after: BIGINT>", "named_struct('low', greatest(low - width, 0L), 'high', least(high + width, n), 'before', low - greatest(low - width, 0L), 'after', least(high + width, n) - high)"),
    }
    return {head.partition("(")[0]: f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}" for head, (kind, body) in made.items()}


def register(spark: SparkSession) -> list[str]:
    """Make the functions in a session; their names."""
    found = definitions()
    for statement in found.values():
        spark.sql(statement)
    spark.udtf.register("chunk_grid", ChunkGrid)
    return [*found, "chunk_grid"]
