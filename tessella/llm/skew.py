"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a task takes.
HOT_ROWS = 10_000


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``facts`` by ``keys``; ``how`` is inner or left.

    Keys with more than HOT_ROWS rows are dealt by a hash of the columns ``by`` to several tasks, each with its own copy of the facts.
    The list of such keys, which is broadcast, has at most 1 / HOT_ROWS as many entries as there are rows.
    ``counted``: a cheaper table with the same keys as often as ``rows`` has them. No column may be named __share or __shares.
    """
    often = (counted if counted is not None else rows).groupBy(*keys).agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("__shares")).where("__shares > 1")
    often = F.broadcast(often)
    shares: Column = F.coalesce("__shares", F.lit(1))
    dealt = rows.join(often, keys, "left").withColumn("__share", F.pmod(F.xxhash64(*by), shares).cast("int")).drop("__shares")
    copies = facts.join(often, keys, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return dealt.join(copies, [*keys, "__share"], how).drop("__share")
