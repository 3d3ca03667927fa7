"""Arrays behind URLs: chunk payloads (compressed ``.npy``) fetched by the tasks that need them."""

from __future__ import annotations

import io
import urllib.request
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import ArrayDataset
from ..operators.encode import decompress
from ..operators.slicing import SliceSpec


def payload_url(template: str, place: dict) -> str:
    """``template`` with {r}, {t}, {c}, {cz}, {cy} and {cx} filled in; for a service also {z0}, {z1}, ... of the box."""
    return template.format(**place)


def read_remote(spark: SparkSession, ds: ArrayDataset, template: str, spec: SliceSpec, raw_bytes: int, codec: str = "zstd") -> DataFrame:
    """Voxels of a slice. Only chunks that it touches are fetched, one task a row of chunks; the slice itself stays a filter."""
    level = ds.level(spec.r)
    spans = [range(a.start // k, -(-a.stop // k)) for a, k in zip(spec.axes, ds.chunks(spec.r), strict=True)]
    rows = [(t, c, z) for t in spans[0] for c in spans[1] for z in spans[2]]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c, cz in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for cy in spans[3]:
                    for cx in spans[4]:
                        place = {"r": spec.r, "t": t, "c": c, "cz": cz, "cy": cy, "cx": cx} | _box((cz, cy, cx), level.chunk, level.shape)
                        with urllib.request.urlopen(payload_url(template, place), timeout=60) as f:
                            block = np.load(io.BytesIO(decompress(f.read(), codec, raw_bytes)))[0]
                        low = [place[f"{a}0"] for a in "zyx"]
                        block = block[tuple(slice(0, n - m) for n, m in zip(level.shape, low, strict=True))]
                        index = [i + m for i, m in zip(np.indices(block.shape, np.int32).reshape(3, -1), low, strict=True)]
                        fixed = [np.full(block.size, v, np.int32) for v in (t, c)]
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in [*fixed, *index]] + [pa.array(block.ravel().astype(np.float64))], ["t", "c", "z", "y", "x", "v"])

    table = spark.createDataFrame(rows, "t int, c int, cz int").repartition(max(1, len(rows)))
    return spec.apply(table.mapInArrow(fetch, "t int, c int, z int, y int, x int, v double"))


def _box(place: Sequence[int], chunk: Sequence[int], shape: Sequence[int]) -> dict[str, int]:
    out = {}
    for a, i, k, n in zip("zyx", place, chunk, shape, strict=True):
        out |= {f"{a}0": i * k, f"{a}1": min((i + 1) * k, n)}
    return out
