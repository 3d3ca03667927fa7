"""Slices of 5-D voxel tables: normalised on the driver, applied as predicates that prune chunks and push down."""

from __future__ import annotations

import ast
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("t", "c", "z", "y", "x")
WIRE_KEYS = ("dset", "res", *(f"{a}{part}" for a in AXES for part in ("start", "stop", "step")))


@dataclass(frozen=True)
class AxisSlice:
    start: int
    stop: int
    step: int = 1

    @property
    def size(self) -> int:
        return max(0, -(-(self.stop - self.start) // self.step))


def out_size(start: Column, stop: Column, step: Column) -> Column:
    """``AxisSlice.size`` of columns."""
    return F.greatest(F.ceil((stop - start) / step), F.lit(0)).cast("long")


def normalize(key: int | slice | None, n: int, stop_only: str = "prefix") -> AxisSlice:
    """One axis of length n. An int i is [i, i+1); ``slice(None, n)`` is the prefix, or with "index" just index n."""
    if stop_only not in ("prefix", "index"):
        raise ValueError(stop_only)
    if key is None:
        return AxisSlice(0, n)
    if isinstance(key, int):
        start, stop, step = key, key + 1, 1
    else:
        start, stop, step = key.start, key.stop, key.step
        if start is None and stop is not None:
            if step is not None:
                start = max(0, stop - 1)
            elif stop_only == "index":
                start, stop = stop, stop + 1
            else:
                start = 0
        start, stop, step = start or 0, n if stop is None else stop, step or 1
    if start < 0 or stop < 0 or step < 1:
        raise ValueError("negative starts, stops and steps are not supported")
    if start > n or stop > n:
        raise ValueError(f"slice {start}:{stop} beyond an axis of {n}")
    return AxisSlice(start, stop, step)


@dataclass(frozen=True)
class SliceSpec:
    """Five axis slices at one level."""

    axes: tuple[AxisSlice, ...]
    r: int = 0

    @classmethod
    def of(cls, key: object, shape: tuple[int, ...], levels: int = 1, lock: int = 0, stop_only: str = "prefix") -> SliceSpec:
        """``key`` as between brackets: up to five axes, or six with the level first; a lone int is a t."""
        keys = key if isinstance(key, tuple) else (key,)
        r = lock
        if len(keys) == 6:
            r, *keys = keys
        if len(keys) > 5:
            raise ValueError("too many axes")
        if not 0 <= r < levels:
            raise ValueError(f"level {r} of {levels}")
        keys = [*keys, *[None] * (5 - len(keys))]
        return cls(tuple(normalize(None if k in (None, slice(None)) else k, n, stop_only) for k, n in zip(keys, shape, strict=True)), r)

    @classmethod
    def from_query(cls, query: Mapping[str, str], shape: tuple[int, ...], levels: int = 1) -> tuple[str, SliceSpec]:
        """The dataset and slice of a request's parameters; on the wire a lone stop means that index."""
        missing = [k for k in WIRE_KEYS if k not in query]
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        value = {k: ast.literal_eval(query[k]) for k in WIRE_KEYS[1:]}
        if any(v is not None and not isinstance(v, int) for v in value.values()):
            raise ValueError("parameters are integers or None")
        keys = tuple(slice(value[f"{a}start"], value[f"{a}stop"], value[f"{a}step"]) for a in AXES)
        return query["dset"], cls.of((value["res"] or 0, *keys), shape, levels, stop_only="index")

    @property
    def out_shape(self) -> tuple[int, ...]:
        return tuple(a.size for a in self.axes)

    def predicate(self, chunk: Mapping[str, int] | None = None) -> Column:
        """Range and step of each axis; for axes with a chunk size also the range of chunk numbers ``c<axis>``, by which files are pruned."""
        parts = []
        for name, a in zip(AXES, self.axes, strict=True):
            parts.append((F.col(name) >= a.start) & (F.col(name) < a.stop))
            if a.step > 1:
                parts.append((F.col(name) - a.start) % a.step == 0)
            if chunk and name in chunk and a.stop > a.start:
                parts.append(F.col(f"c{name}").between(a.start // chunk[name], (a.stop - 1) // chunk[name]))
        return reduce(lambda p, q: p & q, parts)

    def apply(self, voxels: DataFrame, chunk: Mapping[str, int] | None = None, squeeze: bool = False) -> DataFrame:
        """The voxels inside, renumbered from 0 in steps; ``squeeze`` drops axes of length 1."""
        out = voxels.where(self.predicate(chunk))
        moved = {n: F.floor((F.col(n) - a.start) / a.step).cast("int") if a.step > 1 else F.col(n) - a.start for n, a in zip(AXES, self.axes, strict=True)}
        out = out.withColumns(moved)
        return out.drop(*(n for n, a in zip(AXES, self.axes, strict=True) if squeeze and a.size == 1))


def evenly_spaced(n: Column, m: int) -> Column:
    """Array of m indices from 0 to n - 1, half-even rounded; one index is 0."""
    if m == 1:
        return F.array(F.lit(0).cast("long"))
    i = F.sequence(F.lit(0), F.lit(m - 1))
    return F.transform(i, lambda k: F.rint(k * (n - 1) / F.lit(float(m - 1))).cast("long"))


def full_chunk_sample(chunks: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pseudorandom chunks (with ``full`` true where no axis is cut short), the same on every run."""
    order = F.md5(F.concat_ws(".", F.lit(seed), "t", "c", "cz", "cy", "cx"))
    return chunks.where("full").orderBy(order, "t", "c", "cz", "cy", "cx").limit(n)
