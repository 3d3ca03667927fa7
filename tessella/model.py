"""Datasets, levels and channels of multiscale arrays (axes t, c, z, y, x)."""

from __future__ import annotations

from dataclasses import dataclass, field

#: numpy name -> (zarr code, bytes, largest value as an integer, largest value of the 8-bit scaling table)
DTYPES = {
    "uint8": ("|u1", 1, 255, 254),
    "uint16": ("<u2", 2, 65535, 65534),
    "float32": ("<f4", 4, 1, 1),
    "float64": ("<f8", 8, 1, 1),
}


class UnsupportedDtype(TypeError):
    pass


def dtype_code(dtype: str) -> str:
    if dtype not in DTYPES:
        raise UnsupportedDtype(f"{dtype} is none of {', '.join(DTYPES)}")
    return DTYPES[dtype][0]


@dataclass(frozen=True)
class Level:
    """One resolution level: shape and chunk shape in z, y, x and voxel size in micrometres."""

    r: int
    shape: tuple[int, int, int]
    chunk: tuple[int, int, int]
    resolution: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // k) for n, k in zip(self.shape, self.chunk, strict=True))


@dataclass(frozen=True)
class ArrayDataset:
    """T and C belong to the dataset, z, y, x to its levels; there is no second, per-key idea of a shape."""

    name: str
    dtype: str
    T: int
    C: int
    levels: tuple[Level, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        dtype_code(self.dtype)

    def level(self, r: int) -> Level:
        if not 0 <= r < len(self.levels):
            raise ValueError(f"level {r} of {len(self.levels)}")
        return self.levels[r]

    def shape(self, r: int = 0) -> tuple[int, ...]:
        return (self.T, self.C, *self.level(r).shape)

    def chunks(self, r: int = 0) -> tuple[int, ...]:
        return (1, 1, *self.level(r).chunk)

    def nbytes(self, r: int = 0) -> int:
        total = DTYPES[self.dtype][1]
        for n in self.shape(r):
            total *= n
        return total
