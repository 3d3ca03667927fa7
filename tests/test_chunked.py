"""Operators on chunk tables against numpy and against those on voxels."""

import contextlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.model import ArrayDataset, Level
from tessella.operators import chunked, encode, halo, neighborhood, pyramid, reduce
from tessella.operators.chunked import AxisMean, ChunkGrid
from tessella.operators.slicing import SliceSpec
from tessella.plans import pyramids
from tessella.sources.stores import Store

SHAPE, CHUNK = (2, 2, 5, 9, 14), (2, 4, 4)


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(7).integers(0, 65536, SHAPE).astype(np.int64)


def table(spark, array, chunk=CHUNK, codec="zstd", cut=False, dtype="uint16"):
    """The chunk table of an array, made by numpy alone."""
    grid = ChunkGrid(array.shape[2:], chunk, dtype, cut)
    rows = []
    for t in range(array.shape[0]):
        for c in range(array.shape[1]):
            for at in np.ndindex(*(-(-n // k) for n, k in zip(grid.shape, chunk, strict=True))):
                block = array[t, c][tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, chunk, strict=True))]
                if not cut:
                    block = np.pad(block, [(0, k - n) for k, n in zip(chunk, block.shape, strict=True)])
                data = np.ascontiguousarray(block, grid.code).tobytes()
                rows.append((0, t, c, *at, dtype, codec, encode.compress(data, codec, 2), block.size))
    return spark.createDataFrame(rows, encode.CHUNK_FIELDS), grid


def dense(chunks, grid, head=None):
    """The array that a chunk table holds, by numpy alone."""
    rows = chunks.collect()
    head = head or (max(r["t"] for r in rows) + 1, max(r["c"] for r in rows) + 1)
    out = np.full((*head, *grid.shape), -1.0)
    for r in rows:
        at = (r["cz"], r["cy"], r["cx"])
        place = tuple(slice(i * k, i * k + k) for i, k in zip(at, grid.chunk, strict=True))
        out[(r["t"], r["c"], *place)] = grid.decode(r["payload"], r["codec"], at)
    return out


def shuffles(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", [(0, 1, slice(1, 5, 2), slice(2, 9, 3), slice(0, 13)), (slice(None), 0, 4), 1, (0, 0, 0, 0, slice(3, 4))])
@pytest.mark.parametrize("chunk", [None, (3, 2, 5)])
@pytest.mark.parametrize("cut", [False, True])
def test_slices(spark, array, key, chunk, cut):
    chunks, grid = table(spark, array, cut=cut)
    spec = SliceSpec.of(key, SHAPE)
    got, made = chunked.slice_chunks(chunks, grid, spec, chunk)
    keys = key if isinstance(key, tuple) else (key,)
    assert (dense(got, made) == array[tuple(slice(k, k + 1) if isinstance(k, int) else k for k in keys)]).all()


def test_slices_prune_and_may_need_no_shuffle(spark, array, tmp_path):
    chunks, grid = table(spark, array)
    chunks.write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    aligned, _ = chunked.slice_chunks(stored, grid, SliceSpec.of((0, 0, slice(2, 4), slice(0, 8), slice(4, 12)), SHAPE))
    plan = shuffles(aligned)
    assert "Exchange" not in plan and "GreaterThanOrEqual(cz,1)" in plan and "Generate" not in plan
    askew, _ = chunked.slice_chunks(stored, grid, SliceSpec.of((0, 0, slice(1, 4)), SHAPE))
    assert shuffles(askew).count("\nExchange") <= 1 and "Generate" not in shuffles(askew)


@pytest.mark.parametrize("chunk", [(1, 1, 1), (3, 5, 7), (5, 9, 14), (64, 64, 64), (4, 2, 4), (2, 2, 2)])
@pytest.mark.parametrize("codec", ["null", "zlib", "blosc"])
def test_rechunk(spark, array, chunk, codec):
    chunks, grid = table(spark, array, codec=codec)
    got, made = chunked.rechunk(chunks, grid, chunk, codec)
    assert (dense(got, made) == array).all()
    assert made.chunk == chunk and got.count() == 4 * math.prod(-(-n // k) for n, k in zip(SHAPE[2:], chunk, strict=True))
    again, same = chunked.rechunk(got, made, CHUNK, codec)
    assert sorted(bytes(r["payload"]) for r in again.collect()) == sorted(bytes(r["payload"]) for r in chunks.collect()) and same == grid


def test_missing_chunks_hold_zeros(spark, array):
    chunks, grid = table(spark, array)
    some = chunks.where("cz <> 1 or cx <> 0")
    got, made = chunked.rechunk(some, grid, (3, 3, 3))
    want = array.copy()
    want[:, :, 2:4, :, 0:4] = 0
    assert (dense(got, made) == want).all()


@pytest.mark.parametrize(("step", "offset"), [((2, 2, 2), 0), ((2, 2, 2), 1), ((1, 3, 2), 1), ((1, 1, 1), 0)])
def test_decimation(spark, array, step, offset):
    chunks, grid = table(spark, array)
    got, made = chunked.decimate_chunks(chunks, grid, step, offset)
    assert (dense(got, made) == array[(..., *(slice(offset if s > 1 else 0, None, s) for s in step))]).all()


@pytest.mark.parametrize("edge", ["floor", "zero_pad", "partial"])
@pytest.mark.parametrize(("factor", "chunk"), [((2, 2, 2), None), ((1, 4, 2), (1, 1, 2)), ((3, 2, 5), (2, 2, 2))])
def test_block_means_are_those_of_voxels(spark, array, edge, factor, chunk):
    chunks, grid = table(spark, array)
    got, made = chunked.mean_chunks(chunks, grid, factor=factor, edge=edge, chunk=chunk)
    voxels = encode.voxels_of(chunks, CHUNK, SHAPE[2:], "uint16").drop("r", "cz", "cy", "cx")
    want = np.full((2, 2, *made.shape), -1.0)
    for r in reduce.block_reduce(voxels, factor, SHAPE[2:], edge).collect():
        want[r["t"], r["c"], r["z"], r["y"], r["x"]] = r["v"]
    assert (dense(got, made) == want).all()


def area_means(array, target):
    """Cell by cell, with fractions of voxels as floats."""
    out = np.zeros((*array.shape[:2], *target))
    spans = [[(i * n / m, (i + 1) * n / m) for i in range(m)] for n, m in zip(array.shape[2:], target, strict=True)]
    for at in np.ndindex(*target):
        weights = [np.clip(np.minimum(np.arange(n) + 1, spans[a][at[a]][1]) - np.maximum(np.arange(n), spans[a][at[a]][0]), 0, None) for a, n in enumerate(array.shape[2:])]
        cell = np.einsum("tczyx,z,y,x->tc", array.astype(float), *weights)
        out[(..., *at)] = cell / math.prod(b - a for a, b in (spans[k][at[k]] for k in range(3)))
    return out


@pytest.mark.parametrize(("target", "chunk"), [((3, 6, 9), (2, 2, 2)), ((5, 9, 7), None), ((4, 9, 1), (3, 5, 1)), ((5, 9, 14), None)])
def test_means_of_cells_that_end_within_voxels(spark, array, target, chunk):
    chunks, grid = table(spark, array)
    got, made = chunked.mean_chunks(chunks, grid, target, chunk=chunk)
    want = area_means(array, target)
    assert made.shape == target and np.abs(dense(got, made) - want).max() <= 0.5 + 1e-6
    voxels = encode.voxels_of(chunks, CHUNK, SHAPE[2:], "uint16").drop("r", "cz", "cy", "cx")
    by_voxel = np.full(want.shape, -1.0)
    for r in reduce.area_mean(voxels, SHAPE[2:], target).collect():
        by_voxel[r["t"], r["c"], r["z"], r["y"], r["x"]] = r["v"]
    assert (by_voxel == dense(got, made)).all()


def test_weights_fill_cells():
    for n, m in ((9, 6), (14, 9), (5, 5), (7, 1), (300, 200)):
        axis = AxisMean(n, m)
        whole = np.zeros((m, n), int)
        for low in range(0, n, 4):
            size = min(4, n - low)
            first, last = axis.cells(low, size)
            whole[first:last, low : low + size] += axis.weights(low, size)
        assert (whole.sum(1) == axis.cell).all() and (whole.sum(0) == axis.each).all()


def test_build_has_the_shapes_of_an_anisotropic_plan(spark):
    array = np.random.default_rng(3).integers(0, 65536, (1, 1, 8, 30, 30)).astype(np.int64)
    assert [p.shape for p in pyramids.plan_isotropic((64, 300, 300), (1.5, 1, 1))][1] == (64, 200, 200)
    plan = [Level(0, (8, 30, 30), (4, 8, 8)), Level(1, (8, 20, 20), (4, 8, 8)), Level(2, (5, 10, 10), (2, 16, 5))]
    chunks, _ = table(spark, array, plan[0].chunk)
    ds = ArrayDataset("d", "uint16", 1, 1, tuple(plan))
    levels = chunked.build_chunks(chunks, ds, plan)
    voxels = encode.voxels_of(chunks, plan[0].chunk, plan[0].shape, "uint16").drop("r", "cz", "cy", "cx")
    before = array.astype(float)
    for level, made, by_voxel in zip(plan, levels, pyramid.build(voxels, plan), strict=True):
        got = dense(made, ChunkGrid.of(ds, level.r))
        if level.r:
            assert np.abs(got - area_means(before, level.shape)).max() <= 0.5 + 1e-6
            held = np.zeros(level.shape)
            for r in by_voxel.collect():
                held[r["z"], r["y"], r["x"]] = r["v"]
            assert (held == got[0, 0]).all() and [r["r"] for r in made.select("r").distinct().collect()] == [level.r]
        before = got


def test_build_takes_whole_factors_only_for_other_reductions(spark, array):
    chunks, _ = table(spark, array)
    voxels = encode.voxels_of(chunks, CHUNK, SHAPE[2:], "uint16").drop("r", "cz", "cy", "cx")
    with pytest.raises(ValueError, match="no whole factors"):
        pyramid.build(voxels, [Level(0, (5, 9, 14), CHUNK), Level(1, (5, 9, 9), CHUNK)], lambda v, f, s: v)


@pytest.mark.parametrize("nonzero", [False, True])
@pytest.mark.parametrize("key", [None, (slice(None), 1, slice(1, 4), slice(0, 9, 2), slice(5, 6))])
def test_reductions(spark, array, nonzero, key):
    low = array % 5 * (array % 3)
    chunks, grid = table(spark, low)
    spec = SliceSpec.of(key, SHAPE) if key else None
    part = low[key if key else ...].reshape(2, 1, *low[key].shape[1:]) if key else low
    got = {(r["t"], r["c"]): (r["vmin"], r["vmax"], r["n"]) for r in chunked.channel_range(chunks, grid, spec, nonzero).collect()}
    channels = [1] if key else [0, 1]
    want = {}
    for t in range(2):
        for i, c in enumerate(channels):
            v = part[t, i]
            w = v[v > 0] if nonzero else v
            want[t, c] = (int(w.min()), int(w.max()), v.size) if w.size else (None, None, v.size)
    assert got == want
    bins = {(r["t"], r["c"], r["bin"]): r["n"] for r in chunked.histogram(chunks, grid, 4, 15, spec).collect()}
    assert bins == {(t, c, b): n for t in range(2) for i, c in enumerate(channels) for b, n in zip(*np.unique(part[t, i] // 4, return_counts=True), strict=True)}


def test_floats_and_empty_tables(spark):
    array = np.random.default_rng(1).normal(size=(1, 1, 4, 4, 5))
    chunks, grid = table(spark, array, dtype="float64", codec="null")
    got, made = chunked.mean_chunks(chunks, grid, factor=(2, 2, 2), edge="partial")
    assert np.allclose(dense(got, made)[..., :2], array[..., :4].reshape(1, 1, 2, 2, 2, 2, 2, 2).mean((3, 5, 7)))
    r = chunked.channel_range(chunks, grid).first()
    assert (r["vmin"], r["vmax"]) == (array.min(), array.max())
    none = chunks.where("false")
    for df in (chunked.rechunk(none, grid, (3, 3, 3))[0], chunked.channel_range(none, grid), chunked.histogram(none, grid, 4), chunked.mean_chunks(none, grid, factor=(2, 2, 2))[0]):
        assert df.count() == 0
    small, tiny = chunked.mean_chunks(chunks, grid, factor=(8, 1, 1))
    assert small.count() == 0 and tiny.shape == (0, 4, 5)
    with pytest.raises(ValueError, match="does not fit"):
        chunked.mean_chunks(chunks, grid, (5, 4, 5))


def test_tiles_without_voxels_are_there(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 0, 3, 5), (0, 1, 0, 0, 150, 7)], "t int, c int, z int, y int, x int, v int")
    for made in (neighborhood.box_sum(voxels, (1, 1, 200)), neighborhood.gaussian(voxels, (1, 1, 200), 0.5)):
        rows = made.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("c").collect()
        assert [tuple(r) for r in rows] == [(0, 200, 0, 199), (1, 200, 0, 199)]
    got = {r["x"]: r["v"] for r in neighborhood.box_sum(voxels, (1, 1, 200)).where("c = 1 and v <> 0").collect()}
    assert got == {149: 7.0, 150: 7.0, 151: 7.0}


def test_two_attempts_of_one_write(tmp_path):
    store = Store(str(tmp_path))
    begun = store.fs.open_output_stream
    opened = []

    class Slow:
        """The first attempt is still writing when the second begins and ends."""

        def __getattr__(self, name):
            return getattr(store_fs, name)

        def open_output_stream(self, path):
            opened.append(path)
            if len(opened) == 1:
                Store(str(tmp_path)).write("a/b", b"second")
            return begun(path)

    store_fs, store.fs = store.fs, Slow()
    store.write("a/b", b"first")
    assert Store(str(tmp_path)).read("a/b") == b"first" and Store(str(tmp_path)).names() == ["a/b"]
    assert not list(tmp_path.rglob("*.part"))


# halos


@pytest.mark.parametrize("sigma", [0.5, 1.3])
@pytest.mark.parametrize("cut", [False, True])
def test_halos_give_the_dense_gaussian(spark, array, sigma, cut):
    chunks, grid = table(spark, array, cut=cut)
    got, made = halo.gaussian_chunks(chunks, grid, sigma, dtype="float64")  # 1.3: five voxels, more than a chunk
    voxels = encode.voxels_of(table(spark, array)[0], CHUNK, SHAPE[2:], "uint16").drop("r", "cz", "cy", "cx")
    want = np.full(SHAPE, -1.0)
    for r in neighborhood.gaussian(voxels, SHAPE[2:], sigma).collect():
        want[r["t"], r["c"], r["z"], r["y"], r["x"]] = r["v"]
    assert np.allclose(dense(got, made), want)
    padded, weights = np.pad(array.astype(float), [(0, 0), (0, 0), *[(9, 9)] * 3], mode="edge"), neighborhood.gaussian_weights(sigma)
    for axis in (2, 3, 4):
        padded = np.apply_along_axis(lambda v: np.convolve(v, weights, "same"), axis, padded)
    assert np.allclose(want, padded[:, :, 9:-9, 9:-9, 9:-9])


@pytest.mark.parametrize("boundary", ["reflect", "nearest", "zero"])
def test_halos_at_borders_and_around_missing_chunks(spark, array, boundary):
    chunks, grid = table(spark, array)
    some = chunks.where("cz <> 1 or cx <> 0")
    there = array.astype(float)
    there[:, :, 2:4, :, 0:4] = 0

    def spread(block):
        return neighborhood.shifted(neighborhood.shifted(block, 0, [1.0, 2.0, 4.0]), 2, [8.0, 0.0, 1.0])

    got, made = halo.map_chunks(some, grid, spread, 1, boundary, "float64")
    want = np.zeros(SHAPE)
    for at in np.ndindex(*SHAPE[:2]):
        want[at] = spread(np.pad(there[at], 1, mode=halo.MODES[boundary]))[1:-1, 1:-1, 1:-1]
    assert np.allclose(dense(got, made), want)


def test_whole_numbers_are_kept_within_the_type(spark, array):
    chunks, grid = table(spark, array)
    got, made = halo.box_chunks(chunks, grid)
    assert dense(got, made).max() == 65535 and made.dtype == "uint16"
    plain, _ = halo.map_chunks(chunks, grid, lambda b: b / 2)
    assert (dense(plain, grid) == np.rint(array / 2)).all() and "Exchange" not in shuffles(plain)


def test_halos_grow_with_the_surface(spark):
    array = np.zeros((1, 1, 32, 32, 32), np.int64)
    for side in (4, 8, 16):
        chunks, grid = table(spark, array, (side,) * 3)
        sent = halo.halos(chunks, grid, 1).agg(F.sum(F.length("payload"))).first()[0]
        inner = 32 // side
        shell = sum(math.prod(min(32, i * side + side + 1) - max(0, i * side - 1) for i in at) - side**3 for at in np.ndindex(inner, inner, inner))
        assert sent == 2 * shell


def test_bucketed_chunks_stay_where_they_lie(spark, array):
    chunks, grid = table(spark, array)
    kept = halo.bucketed(chunks, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, made = halo.gaussian_chunks(kept, grid, 0.5, dtype="float64")
        plan = shuffles(got)
        assert plan.count("\nExchange") + plan.count(") Exchange") <= 2 and "SelectedBucketsCount: 4 out of 4" in plan or "Bucketed: true" in plan
        want, _ = halo.gaussian_chunks(chunks, grid, 0.5, dtype="float64")
        assert np.allclose(dense(got, made), dense(want, made))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
