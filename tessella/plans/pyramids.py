"""Plans of resolution pyramids: shapes, chunks and voxel sizes of all levels. Pure functions of the full resolution."""

from __future__ import annotations

from ..model import Level

Triple = tuple[int, int, int]


def _halved(shape: Triple) -> Triple:
    return tuple(max(1, n // 2) for n in shape)


def plan_halving(shape: Triple, chunk: Triple, resolution: tuple[float, float, float] = (1.0, 1.0, 1.0), stop: str = "any", smallest: int = 128, grow: int = 4) -> list[Level]:
    """Shapes halve; chunks grow ``grow``-fold in z up to ``smallest`` and halve in y and x down to it.

    The first level of which any axis (or all, by ``stop``) is shorter than its chunk is not part of the plan. With "all",
    where an axis may be shorter, chunks are cut to the shape.
    """
    if stop not in ("any", "all"):
        raise ValueError(stop)
    levels, ends = [Level(0, shape, chunk, resolution)], any if stop == "any" else all
    while True:
        shape = tuple(n // 2 for n in shape)
        z, y, x = chunk
        chunk = (min(z * grow, smallest), max(y // 2, smallest), max(x // 2, smallest))
        resolution = tuple(v * 2 for v in resolution)
        if ends(n < k for n, k in zip(shape, chunk, strict=True)) or 0 in shape:
            break
        levels.append(Level(len(levels), shape, chunk, resolution))
    return levels if stop == "any" else [Level(v.r, v.shape, tuple(min(k, n) for k, n in zip(v.chunk, v.shape, strict=True)), v.resolution) for v in levels]


def plan_passes(shape: Triple, start: Triple, passes: int = 3, grow: int = 4, resolution: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[Level]:
    """Several passes of halving; between passes chunks grow in z and halve in y and x. A pass ends where an axis fits its chunk."""
    levels, r, chunk = [Level(0, shape, start, resolution)], 0, start
    for _ in range(passes):
        while all(n > k for n, k in zip(shape, chunk, strict=True)):
            shape, r = _halved(shape), r + 1
            resolution = tuple(v * 2 for v in resolution)
            levels.append(Level(r, shape, tuple(min(k, n) for k, n in zip(chunk, shape, strict=True)), resolution))
        z, y, x = chunk
        chunk = (z * grow, max(1, y // 2), max(1, x // 2))
    return levels


def plan_isotropic(shape: Triple, resolution: tuple[float, float, float], chunk: Triple = (4, 512, 512), smallest: int = 16, every: int = 2) -> list[Level]:
    """Axes finer than the coarsest are reduced (by 2 at most) until voxels are cubes, then all by 2; ends where half of an
    axis is ``smallest`` or less. Every ``every`` levels chunks double in z and halve in y and x."""
    levels = [Level(0, shape, chunk, resolution)]
    while all(n // 2 > smallest for n in shape):
        coarsest = max(resolution)
        if len({round(v, 9) for v in resolution}) > 1:
            factor = tuple(min(2.0, coarsest / v) for v in resolution)
        else:
            factor = (2.0, 2.0, 2.0)
        shape = tuple(int(n // f) for n, f in zip(shape, factor, strict=True))
        resolution = tuple(v * f for v, f in zip(resolution, factor, strict=True))
        if len(levels) % every == 0:
            chunk = (chunk[0] * 2, max(1, chunk[1] // 2), max(1, chunk[2] // 2))
        levels.append(Level(len(levels), shape, chunk, resolution))
    return levels
