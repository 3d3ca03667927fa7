"""Array operators against numpy."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from tessella.functions import values
from tessella.model import ArrayDataset, Level, UnsupportedDtype
from tessella.operators import encode, grid, metadata, neighborhood, pyramid, reduce, slicing
from tessella.plans import pyramids
from tessella.sources import blosc, config, tiff, zarr, zshard

SHAPE = (2, 2, 5, 9, 7)


@pytest.fixture(scope="module")
def array():
    return np.random.default_rng(42).integers(0, 65536, SHAPE).astype(np.int64)


@pytest.fixture(scope="module")
def voxels(spark, array):
    index = np.indices(SHAPE).reshape(5, -1)
    rows = [tuple(map(int, r)) for r in np.vstack([index, array.ravel()]).T]
    return spark.createDataFrame(rows, "t int, c int, z int, y int, x int, v int").cache()


def dense(df, shape):
    out = np.full(shape, -1.0)
    for r in df.collect():
        out[tuple(r[a] for a in "tczyx")] = r["v"]
    return out


axis = st.one_of(st.none(), st.integers(0, 3), st.builds(lambda a, n, s: slice(a, a + n, s), st.integers(0, 3), st.integers(0, 4), st.integers(1, 3)), st.builds(lambda n: slice(None, n), st.integers(0, 6)))


@given(st.tuples(*[axis] * 5))
@settings(max_examples=200, deadline=None)
def test_slice_shape_is_numpys(key):
    shape = (8, 8, 8, 8, 8)
    whole = np.empty(shape)[tuple(slice(k, k + 1) if isinstance(k, int) else slice(None) if k is None else k for k in key)]
    assert slicing.SliceSpec.of(key, shape).out_shape == whole.shape


@pytest.mark.parametrize("key", [(0, 1, slice(1, 5, 2), slice(2, 9, 3), slice(0, 7)), (slice(None), 0, 4), 1])
def test_slice_values(voxels, array, key):
    spec = slicing.SliceSpec.of(key, SHAPE)
    keys = key if isinstance(key, tuple) else (key,)
    want = array[tuple(slice(k, k + 1) if isinstance(k, int) else k for k in keys)]
    assert (dense(spec.apply(voxels), spec.out_shape) == want).all()


def test_slice_errors_and_stop_only():
    with pytest.raises(ValueError):
        slicing.SliceSpec.of((0, 0, 0, 0, slice(0, 8)), SHAPE)
    with pytest.raises(ValueError):
        slicing.SliceSpec.of((3, 0, 0, 0, 0, 0), SHAPE, levels=2)
    assert slicing.normalize(slice(None, 3), 9) == slicing.AxisSlice(0, 3)
    assert slicing.normalize(slice(None, 3), 9, "index") == slicing.AxisSlice(3, 4)
    assert slicing.normalize(slice(None, 3, 2), 9) == slicing.AxisSlice(2, 3, 2)


def test_slice_prunes_files_and_pushes_filters(spark, voxels, tmp_path):
    grid.with_chunks(voxels, (2, 4, 4)).write.partitionBy("c", "cz").parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    spec = slicing.SliceSpec.of((0, 1, slice(2, 4), None, slice(0, 3)), SHAPE)
    plan = spec.apply(df, {"z": 2})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(c" in plan and "cz" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "LessThan(t,1)" in plan


def test_chunk_names(spark):
    df = spark.range(1).select(F.lit("0.0.1.3.14").alias("n"))
    box = grid.name_to_box(F.col("n"), [F.lit(n) for n in (1, 1, 2, 23857, 14623)], (1, 1, 1, 1000, 1000), open_end=True)
    row = df.select(*(c.alias(k) for k, c in box.items())).first()
    assert (row["z0"], row["z1"], row["y0"], row["y1"], row["x0"], row["x1"]) == (1, None, 3000, 4000, 14000, None)
    assert df.select(grid.dotted_path(F.lit("a/b/0/0/1/3/14"))).first()[0] == "a/b/0.0.1.3.14"
    assert df.select(grid.slashed_path(F.lit("a/b/0.0.1.3.14"))).first()[0] == "a/b/0/0/1/3/14"
    assert df.select(grid.chunk_in_path(F.lit("a.8x256x128.ome.zarr"))).first()[0] == [1, 1, 8, 256, 128]
    assert df.select(grid.chunk_in_path(F.lit("a.64x32.zarr"))).first()[0] == [1, 1, 1, 64, 32]


def test_grid_of_a_large_level(spark):
    level = spark.createDataFrame([(1, 2, 18, 35, 18)], "t_size long, c_size long, z_size long, y_size long, x_size long")
    chunks = grid.enumerate_grid(level, (1, 1, 10, 15, 10)).where("cc = 0")
    names = {r[0] for r in chunks.select(grid.box_name([F.col(f"{a}0") for a in "zyx"], [F.col(f"{a}1") for a in "zyx"])).collect()}
    assert len(names) == 2 * 3 * 2 and "10-18_30-35_10-18" in names and "0-10_0-15_0-10" in names
    assert chunks.where("full").count() == 2
    assert Level(0, (512, 40265, 30564), (1, 1000, 1000)).grid == (512, 41, 31)


def test_helpers_of_grids():
    assert grid.chunk_proposals((4, 256, 512), False) == [[512, 256, 4]]
    assert grid.chunk_proposals((4, 256, 512), 16) == [[512, 256, 16], [512, 16, 256], [16, 512, 256]]
    assert grid.chunk_proposals((4, 256, 512), (1, 2, 3)) == [[1, 2, 3]]
    assert grid.read_depth(1000, 100, 64, 2, 20_000) == 128 and grid.read_depth(100, 100, 64, 2, 10**9) == 100


def test_conversions(spark):
    v = [0, 1, 255, 256, 32767, 32768, 65534, 65535]
    df = spark.createDataFrame([(x,) for x in v], "v int")
    assert [r[0] for r in df.select(values.convert(F.col("v"), "uint16", "uint8")).collect()] == [x >> 8 for x in v]
    f = [-1.0, -0.25, 0.0, 0.5 / 65535, 1.5 / 65535, 0.5, 1.0]
    df = spark.createDataFrame([(x,) for x in f], "v double")
    assert [r[0] for r in df.select(values.convert(F.col("v"), "float64", "uint16")).collect()] == [int(np.clip(np.rint(x * 65535), 0, 65535)) for x in f]
    with pytest.raises(UnsupportedDtype):
        values.convert(F.col("v"), "int32", "uint8")


def test_reductions(voxels, array):
    rows = {(r["t"], r["c"]): (r["vmin"], r["vmax"], r["n"]) for r in reduce.channel_range(voxels).collect()}
    for (t, c), got in rows.items():
        assert got == (array[t, c].min(), array[t, c].max(), 5 * 9 * 7)
    empty = reduce.channel_range(voxels.withColumn("v", F.lit(0)), nonzero=True).first()
    assert empty["vmin"] is None and empty["vmax"] is None


@pytest.mark.parametrize("edge", ["floor", "zero_pad", "partial"])
def test_block_means(voxels, array, edge):
    fz, fy, fx = 2, 4, 3
    pad = [(0, 0), (0, 0)] + [(0, -n % f) for n, f in zip(SHAPE[2:], (fz, fy, fx), strict=True)]
    full = np.pad(array.astype(float), pad, constant_values=np.nan)
    blocks = full.reshape(2, 2, full.shape[2] // fz, fz, full.shape[3] // fy, fy, full.shape[4] // fx, fx)
    want = {"floor": blocks.mean(axis=(3, 5, 7)), "zero_pad": np.nan_to_num(blocks).mean(axis=(3, 5, 7)), "partial": np.nanmean(blocks, axis=(3, 5, 7))}[edge]
    got = dense(reduce.block_reduce(voxels, (fz, fy, fx), SHAPE[2:], edge), want.shape)
    assert (np.where(np.isnan(want), -1, np.rint(want)) == got).all()


def test_pyramid_levels_share_one_shuffle(spark, voxels):
    levels = pyramid.mean_levels(voxels, SHAPE[2:], 2)
    plan = levels[-1][0]._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Final Plan")[0].count("Exchange ") == 1
    assert levels[-1][1] == (1, 2, 1)


def test_decimation(voxels, array):
    assert (dense(pyramid.decimate(voxels, offset=1), (2, 2, 2, 4, 3)) == array[:, :, 1::2, 1::2, 1::2]).all()
    third = pyramid.decimated_pyramid(voxels, 3).where("r = 2")
    assert (dense(third, (2, 2, 2, 3, 2)) == array[:, :, ::4, ::4, ::4]).all()


def test_neighbourhoods(voxels, array):
    z, y, x = SHAPE[2:]
    padded = np.pad(array, [(0, 0), (0, 0), (2, 2), (2, 2), (2, 2)], mode="symmetric")
    shifted = neighborhood.mirror_pad(voxels, (z, y, x), 2).withColumns({a: F.col(a) + 2 for a in "zyx"})
    assert (dense(shifted, padded.shape) == padded).all()
    zeros = np.pad(array, [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1)])
    want = sum(zeros[:, :, a : a + z, b : b + y, c : c + x] for a in range(3) for b in range(3) for c in range(3))
    assert (dense(neighborhood.box_sum(voxels, (z, y, x)), SHAPE) == want).all()
    assert (dense(neighborhood.map_tiles(voxels, (z, y, x), (2, 4, 3), lambda b: sum(np.roll(b, (i, j, k), (0, 1, 2)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)), 1, "zero"), SHAPE) == want).all()
    w = neighborhood.gaussian_weights(0.8)
    want = array.astype(float)
    for a in (2, 3, 4):
        e = np.pad(want, [(len(w) // 2,) * 2 if i == a else (0, 0) for i in range(5)], mode="edge")
        want = sum(k * np.take(e, range(i, i + SHAPE[a]), axis=a) for i, k in enumerate(w))
    assert np.allclose(dense(neighborhood.gaussian(voxels, (z, y, x), 0.8), SHAPE), want)
    tiles = neighborhood.map_tiles(voxels, (z, y, x), (2, 4, 4), lambda b: b + 1, width=1)
    assert (dense(tiles, SHAPE) == array + 1).all()


def test_tiles_see_their_neighbours(voxels, array):
    def left(block):
        return np.roll(block, 1, axis=2)

    want = np.concatenate([array[..., :1], array[..., :-1]], axis=4)
    assert (dense(neighborhood.map_tiles(voxels, SHAPE[2:], (2, 4, 3), left, width=1, boundary="nearest"), SHAPE) == want).all()


def test_halving_plans_end_before_chunks_outgrow_the_shape():
    plan = pyramids.plan_halving((64, 2048, 2048), (1, 1024, 1024))
    assert [(p.shape, p.chunk) for p in plan] == [((64, 2048, 2048), (1, 1024, 1024)), ((32, 1024, 1024), (4, 512, 512)), ((16, 512, 512), (16, 256, 256))]
    assert [p.shape for p in pyramids.plan_halving((6, 4096, 4096), (1, 1024, 1024))] == [(6, 4096, 4096)]  # 3 planes are fewer than 4
    assert [p.shape for p in pyramids.plan_halving((8, 4096, 4096), (1, 1024, 1024))] == [(8, 4096, 4096), (4, 2048, 2048)]  # as many are not
    both = pyramids.plan_halving((16, 600, 600), (1, 1024, 1024), stop="all")
    assert [(p.shape, p.chunk) for p in both] == [((16, 600, 600), (1, 600, 600)), ((8, 300, 300), (4, 300, 300))]  # then 4 < 16 and 150 < 256
    assert both[1].resolution == (2.0, 2.0, 2.0)


def test_isotropic_plan():
    got = pyramids.plan_isotropic((11464, 30801, 20821), (1.0, 0.35, 0.35), chunk=(1, 1024, 1024))
    shapes = [(11464, 30801, 20821), (11464, 15400, 10410), (11464, 10779, 7286), (5732, 5389, 3643), (2866, 2694, 1821), (1433, 1347, 910), (716, 673, 455), (358, 336, 227), (179, 168, 113), (89, 84, 56), (44, 42, 28)]
    chunks = [(1, 1024, 1024)] * 2 + [(2, 512, 512)] * 2 + [(4, 256, 256)] * 2 + [(8, 128, 128)] * 2 + [(16, 64, 64)] * 2 + [(32, 32, 32)]
    assert [p.shape for p in got] == shapes and [p.chunk for p in got] == chunks
    assert [p.resolution for p in got] == [pytest.approx(v) for v in [(1.0, 0.35, 0.35), (1.0, 0.7, 0.7), *((float(2**k),) * 3 for k in range(9))]]


def test_pass_plan():
    plan = pyramids.plan_passes((64, 256, 256), (4, 64, 64))
    assert plan[1].shape == (32, 128, 128) and [p.r for p in plan] == list(range(len(plan)))


def test_build_levels(spark, voxels, array):
    one = voxels.where("t = 0")
    plan = [Level(0, (5, 9, 7), (2, 4, 4)), Level(1, (2, 4, 3), (2, 4, 3)), Level(2, (1, 2, 1), (1, 2, 1))]
    built = pyramid.build(one, plan)
    want = np.rint(array[0, :, :4, :8, :6].reshape(2, 2, 2, 4, 2, 3, 2).mean(axis=(2, 4, 6)))
    assert (dense(built[1], (1, 2, 2, 4, 3))[0] == want).all() and built[2].count() == 2 * 2


def test_metadata_documents():
    ds = ArrayDataset("a", "uint16", 1, 3, (Level(0, (8, 16, 16), (4, 8, 8), (1.0, 0.3, 0.3)), Level(1, (4, 8, 8), (4, 8, 8), (2.0, 0.6, 0.6))))
    doc = metadata.zattrs(ds, [{"vmin": 10, "vmax": 1000}, {"vmin": None, "vmax": None}, {"vmin": 1, "vmax": 60000}])
    assert doc["multiscales"][0]["datasets"][1]["coordinateTransformations"][1]["translation"] == [0.0, 0.0, 1.0, 0.3, 0.3]
    assert doc["omero"]["channels"][0]["window"] == {"start": 10, "end": 1000, "min": 5, "max": 2000}
    assert doc["omero"]["channels"][2]["window"]["max"] == 65535 and doc["omero"]["rdefs"]["defaultZ"] == 4
    text = metadata.shader([{"label": "GFP - a", "vmin": 0, "vmax": 9}, {"vmin": 1, "vmax": 2}])
    assert "gfp___a_visible" in text and "channel=1" in text
    alike = metadata.shader([{"label": "a b", "vmin": 0, "vmax": 9, "active": False}, {"label": "A-B", "vmin": 1, "vmax": 2}])
    assert "a_b_visible checkbox(default=false)" in alike and "a_b_1_visible checkbox(default=true)" in alike
    assert "channel=" not in metadata.shader([{"vmin": 1, "vmax": 2}])
    assert metadata.viewer_link("https://v/", "http://x/ng/a", ds, text).startswith("http://v/#!%7B%22dimensions")
    assert json.loads(metadata.viewer_state("https://x/ng/a", ds, text))["layers"][0]["source"] == "https://x/ng/a"
    assert metadata.metadata_map(ds)["Channels"] == 3


def _pruned(uri, **equal):
    reader = zarr.ZarrReader(uri, zarr.group_arrays)
    list(reader.pushFilters([EqualTo((k,), v) for k, v in (equal | {"r": 0}).items()]))
    return reader.partitions()


def _foreign(folder, block, head, name=lambda at: ".".join(map(str, at)), pack=lambda b: b, ndim=5):
    """A store as another program writes it: whole chunks, also at the edge."""
    folder.mkdir(parents=True)
    block = block.astype("<u2") if block.dtype == np.int64 else block
    head = {"zarr_format": 2, "shape": list(block.shape), "chunks": [1, 1, 2, 4, 4][-ndim:], "dtype": block.dtype.str, "compressor": None, "filters": None, "fill_value": 0, "order": "C"} | head
    (folder / ".zarray").write_text(json.dumps(head))
    chunk = head["chunks"]
    for at in np.ndindex(*(-(-n // k) for n, k in zip(block.shape, chunk, strict=True))):
        part = block[tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, chunk, strict=True))]
        if part.any():
            whole = np.zeros(chunk, block.dtype)
            whole[tuple(slice(0, n) for n in part.shape)] = part
            path = folder / name(at)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(pack(whole.tobytes(order=head["order"])))
    return folder


def _group(folder):
    folder.mkdir(parents=True)
    (folder / ".zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "full"}]}]}))
    return folder


def test_foreign_zarr_stores(spark, array, tmp_path):
    import gzip
    import zlib

    slashes = lambda at: "/".join(map(str, at))
    kinds = {
        "dots": ({}, {}),
        "slashes": ({"dimension_separator": "/"}, {"name": slashes}),
        "fortran": ({"order": "F"}, {}),
        "zlib": ({"compressor": {"id": "zlib", "level": 1}}, {"pack": zlib.compress}),
        "gzip": ({"compressor": {"id": "gzip", "level": 1}}, {"pack": gzip.compress}),
        "blosc": ({"compressor": {"id": "blosc", "cname": "zstd", "clevel": 5, "shuffle": 1, "blocksize": 0}}, {"pack": lambda b: blosc.encode(b, 2)}),
        "lz4": ({"compressor": {"id": "lz4"}}, {"pack": lambda b: len(b).to_bytes(4, "little") + pa.Codec("lz4_raw").compress(b, asbytes=True)}),
        "several": ({"chunks": [2, 2, 2, 4, 4]}, {}),
    }
    for kind, (head, more) in kinds.items():
        folder = _group(tmp_path / f"{kind}.ome.zarr")
        _foreign(folder / "full", array, head, **more)
        assert (dense(config.open_dataset(spark, str(folder)), SHAPE) == array).all(), kind
    assert (dense(config.open_dataset(spark, str(tmp_path / "several.ome.zarr")).where("t = 1 and c = 0"), SHAPE)[1, 0] == array[1, 0]).all()
    big = _group(tmp_path / "big.ome.zarr")
    _foreign(big / "full", array.astype(">u2"), {})
    assert (dense(config.open_dataset(spark, str(big)), SHAPE) == array).all()


def test_fill_values_and_what_is_not_read(spark, array, tmp_path):
    folder = _group(tmp_path / "filled.ome.zarr")
    few = array.copy()
    few[:, :, 2:4, :4, :4] = 0
    _foreign(folder / "full", few, {"fill_value": 7})
    got = dense(config.open_dataset(spark, str(folder)), SHAPE)
    want = few.copy()
    want[:, :, 2:4, :4, :4] = 7
    assert (got == want).all()
    for name, head in (("filters", {"filters": [{"id": "delta"}]}), ("codec", {"compressor": {"id": "lzma"}}), ("v3", {"zarr_format": 3}), ("kind", {"dtype": "<i8"})):
        bad = _group(tmp_path / f"{name}.ome.zarr")
        _foreign(bad / "full", array, head)
        with pytest.raises(Exception, match="filters|lzma|version|i8"):
            config.open_dataset(spark, str(bad)).count()
    flat = _group(tmp_path / "flat.ome.zarr")
    _foreign(flat / "full", array[0, 0, 0], {}, ndim=2)
    with pytest.raises(Exception, match="axes"):
        config.open_dataset(spark, str(flat)).count()


def test_zarr_series(spark, array, tmp_path):
    for t, c in np.ndindex(2, 2):
        _foreign(tmp_path / f"t{t:02d}_c{c:02d}_0.zarr", array[t, c], {}, ndim=3)
        _foreign(tmp_path / f"t{t:02d}_c{c:02d}_1.zarr", array[t, c, ::2, ::2, ::2], {}, ndim=3)
    uri = str(tmp_path / "t00_c01_0.zarr")
    assert (dense(config.open_dataset(spark, uri), SHAPE) == array).all()
    assert (dense(config.open_dataset(spark, uri, 1), (2, 2, 3, 5, 4)) == array[:, :, ::2, ::2, ::2]).all()
    ds = config.describe(uri)
    assert (ds.T, ds.C, len(ds.levels)) == (2, 2, 2) and ds.level(1).resolution == (2.0, 0.6, 0.6)


def test_regions(spark, voxels, array, tmp_path):
    ds = ArrayDataset("a", "uint16", 2, 2, (Level(0, SHAPE[2:], (2, 4, 4)),))
    for codec, order in (("blosc", "F"), ("null", "C")):
        uri = f"{tmp_path}/{codec}.ome.zarr"
        zarr.create_zarr(ds, uri, codec, separator=".", order=order)
        zarr.write_region(voxels.where("z < 3 and x >= 1"), uri)
        zarr.write_region(voxels.where("z >= 3 or x < 1"), uri)
        assert (dense(config.open_dataset(spark, uri), SHAPE) == array).all()


def test_blosc_frames():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 1000, 4096):
        data = np.repeat(rng.integers(0, 255, -(-size // 8), dtype=np.uint8), 8)[:size].tobytes()
        assert all(blosc.decode(blosc.encode(data, k)) == data for k in (1, 2, 4))
    noise = rng.bytes(300)
    assert blosc.decode(blosc.encode(noise, 2)) == noise
    # several blocks, one stream a byte of an element, bits shuffled, another compressor
    data = np.arange(1000, dtype="<u2")
    blocks = [data[:512], data[512:]]
    head, places, body = blosc.HEADER.pack(2, 1, 1 | 1 << 5, 2, 2000, 1024, 0), [], b""
    for i, b in enumerate(blocks):
        places.append(16 + 8 + len(body))
        raw = b.view(np.uint8).reshape(-1, 2).T.ravel().tobytes()
        for part in (raw[:512], raw[512:]) if i == 0 else (raw,):
            packed = pa.Codec("lz4_raw").compress(part, asbytes=True)
            body += len(packed).to_bytes(4, "little") + packed
    assert blosc.decode(head + b"".join(p.to_bytes(4, "little") for p in places) + body) == data.tobytes()
    raw = np.arange(24, dtype="<u2")
    bits = np.packbits(np.unpackbits(raw.view(np.uint8), bitorder="little").reshape(24, 16).T.ravel(), bitorder="little").tobytes()
    packed = pa.Codec("zstd").compress(bits, asbytes=True)
    frame = blosc.HEADER.pack(2, 1, 4 | 16 | 4 << 5, 2, 48, 48, 0) + (20).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed
    assert blosc.decode(frame) == raw.tobytes()
    with pytest.raises(ValueError, match="blosclz"):
        blosc.decode(blosc.HEADER.pack(2, 1, 1, 2, 48, 48, 0) + b"x" * 40)


def test_stores_round_trip(spark, voxels, array, tmp_path):
    levels = (Level(0, SHAPE[2:], (2, 4, 4)), Level(1, (2, 4, 3), (2, 4, 4)))
    ds = ArrayDataset("a", "uint16", 2, 2, levels)
    small = reduce.block_reduce(voxels, (2, 2, 2), SHAPE[2:])
    for codec in encode.CODECS:
        uri = f"{tmp_path}/{codec}.ome.zarr"
        zarr.write_zarr([voxels, small], ds, uri, codec)
        assert zarr.open_group(uri).levels[1].shape == (2, 4, 3)
        back = config.open_dataset(spark, uri)
        assert (dense(back, SHAPE) == array).all()
    numbers = [p.numbers for p in _pruned(uri, t=1, cz=2)]
    assert numbers == [{"t": [1], "c": [0, 1], "cz": [2], "cy": [0, 1, 2], "cx": [0, 1]}]
    assert (dense(zarr.read_zarr(spark, uri).where("r = 0 and t = 1 and cz = 2"), (2, *SHAPE[1:]))[1, :, 4:] == array[1, :, 4:]).all()
    assert config.level_count(zarr.read_zarr(spark, uri)) == 2 and [v.where("v > 0").count() for v in config.level_views(spark, uri)] == [int((array > 0).sum()), small.where("v > 0").count()]
    key = config.register_dataset(spark, uri)
    assert config.register_dataset(spark, uri) == key and spark.table(key).count() == voxels.count() + 2 * 2 * 2 * 4 * 3
    assert config.describe(uri).T == 2 and config.describe(str(tmp_path / "none.zarr")) is None
    zshard.write_zsharded([voxels, small], ds, f"{tmp_path}/b.z_sharded")
    assert (dense(config.open_dataset(spark, f"{tmp_path}/b.z_sharded"), SHAPE) == array).all()
    with pytest.raises(config.MissingDependency):
        config.open_dataset(spark, "/x/y.omehans")


def _tiff(planes, compression, pack, predictor=1):
    """A file of several images, each in strips of two rows."""
    import struct

    out, link = b"II*\0\0\0\0\0", 4
    for plane in planes:
        given = np.diff(plane, axis=1, prepend=np.zeros((len(plane), 1), plane.dtype)) if predictor == 2 else plane
        strips = [pack(given[i : i + 2].tobytes()) for i in range(0, len(given), 2)]
        places = [len(out) + sum(map(len, strips[:i])) for i in range(len(strips))]
        out += b"".join(strips)
        lists = len(out)
        out += struct.pack(f"<{2 * len(strips)}I", *places, *map(len, strips))
        tags = [(256, 3, 1, plane.shape[1]), (257, 3, 1, plane.shape[0]), (258, 3, 1, plane.itemsize * 8), (259, 3, 1, compression), (273, 4, len(strips), lists), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, len(strips), lists + 4 * len(strips)), (317, 3, 1, predictor)]
        out = out[:link] + struct.pack("<I", len(out)) + out[link + 4 :]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return out


def _lzw(data):
    """Codes of 9 bits alone, with a fresh start often enough."""
    codes = []
    for i in range(0, len(data), 200):
        codes += [256, *data[i : i + 200]]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_tiff_kinds(spark):
    import zlib

    planes = [np.arange(35, dtype=np.uint16).reshape(5, 7) * k for k in (1, 50, 3)]
    for compression, pack in ((1, bytes), (8, zlib.compress), (5, _lzw)):
        for predictor in (1, 2):
            made = _tiff(planes, compression, pack, predictor)
            assert tiff.page_count(made) == 3
            assert all((tiff.decode(made, i) == p).all() for i, p in enumerate(planes))
    files = spark.createDataFrame([(0, 1, 4, made)], "t int, c int, z int, content binary")
    assert {(r["z"], r["n"], r["s"]) for r in tiff.planes_to_voxels(files).groupBy("z").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()} == {(4 + i, 35, int(p.sum())) for i, p in enumerate(planes)}
    # codes that grow to 12 bits: "a" repeated makes each code the last one and one more
    text = b"a" * 40_000
    table, out, last = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    n, width = 258, 9
    for byte in text:
        more = last + bytes([byte])
        if more in table:
            last = more
            continue
        out.append((table[last], width))
        table[more], n, last = n, n + 1, bytes([byte])
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    bits = "".join(f"{c:0{w}b}" for c, w in [*out, (table[last], width), (257, width)])
    bits += "0" * (-len(bits) % 8)
    assert tiff.lzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == text
    with pytest.raises(ValueError, match="only grey"):
        tiff.decode(_tiff(planes, 7, bytes))


def test_cubic_resize(voxels, array):
    z, y, x = SHAPE[2:]
    line = voxels.where("t = 0 and c = 0")
    same = dense(neighborhood.resize_cubic(line, (z, y, x), (z, y, x)), (1, 1, z, y, x))
    assert (same[0, 0] == array[0, 0]).all()
    # a cubic spline goes through its points: an odd factor puts every source voxel on a target place
    got = dense(neighborhood.resize_cubic(line, (z, y, x), (z, y, 3 * x)), (1, 1, z, y, 3 * x))
    assert np.allclose(got[0, 0][:, :, 1::3], array[0, 0])
    flat = line.withColumn("v", F.lit(5))
    assert np.allclose(dense(neighborhood.resize_cubic(flat, (z, y, x), (3, 5, 11)), (1, 1, 3, 5, 11)), 5)


def test_box_sums_over_a_divisor(voxels):
    share = voxels.where("t = 0 and c = 0").withColumn("v", F.lit(0.9))
    assert neighborhood.box_sum(share, SHAPE[2:], divisor=27, limit=1.0).agg(F.max("v")).first()[0] == pytest.approx(0.9)
    with pytest.raises(Exception, match="above 1.0"):
        neighborhood.box_sum(share, SHAPE[2:], divisor=12, limit=1.0).agg(F.max("v")).first()


def test_tiff(spark, voxels, array, tmp_path):
    for kind in (np.uint8, np.uint16):
        plane = np.arange(35, dtype=kind).reshape(5, 7)
        assert (tiff.decode(tiff.encode(plane)) == plane).all()
    for r in encode.planes(voxels, SHAPE[2:], "uint16").collect():
        folder = tmp_path / f"T{r['t']}" / f"CH{r['c']}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"p{r['z']:03d}.tif").write_bytes(r["tiff"])
    assert (dense(tiff.read_stack(spark, str(tmp_path)), SHAPE) == array).all()
    from tessella.streaming.planes import arriving_planes

    stream = arriving_planes(spark, str(tmp_path), 3).writeStream.format("memory").queryName("planes").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert (dense(spark.table("planes"), SHAPE) == array).all()


def test_payloads(voxels, array):
    chunks = encode.chunks_of(voxels, (2, 4, 4), "uint16")
    row = chunks.where("t = 1 and c = 0 and cz = 2 and cy = 2 and cx = 1").first()
    block = np.frombuffer(row["payload"], "<u2").reshape(2, 4, 4)
    assert (block[:1, :1, :3] == array[1, 0, 4:, 8:, 4:]).all() and block[1].sum() == 0
    packed = encode.npy_payload(chunks, (2, 4, 4)).first()
    assert packed["raw_bytes"] == 128 + 64 and packed["packed_bytes"] == len(packed["payload"])
    whole = encode.chunks_of(voxels, (5, 9, 7), "uint16", combine_channels=2).where("t = 0").first()
    assert (np.frombuffer(whole["payload"], "<u2").reshape(2, 5, 9, 7) == array[0]).all()


def test_settings(spark, tmp_path):
    (tmp_path / "s.ini").write_text("[dir_anon]\npublic = /data/public\n[dir_auth]\nLab = /data/lab\n")
    (tmp_path / "set.txt").write_text("/a/b.zarr\n\n/c d.ims\n")
    assert {tuple(r) for r in config.mounted_roots(spark, f"{tmp_path}/s.ini").collect()} == {("public", "/data/public", False), ("Lab", "/data/lab", True)}
    assert [r[0] for r in config.collection(spark, f"{tmp_path}/set.txt").collect()] == ["/a/b.zarr", "/c d.ims"]
    assert {r["name"] for r in config.folder_entries(spark, str(tmp_path)).collect()} == {"s.ini", "set.txt"}


def test_remote_chunks(spark, voxels, array, tmp_path):
    from tessella.sources.remote import read_remote

    for r in encode.npy_payload(encode.chunks_of(voxels, (2, 4, 4), "uint16"), (2, 4, 4)).collect():
        (tmp_path / f"0-{r['t']}-{r['c']}-{r['cz']}-{r['cy']}-{r['cx']}").write_bytes(r["payload"])
    ds = ArrayDataset("a", "uint16", 2, 2, (Level(0, SHAPE[2:], (2, 4, 4)),))
    spec = slicing.SliceSpec.of((1, slice(None), slice(1, 5), slice(3, 9, 2), slice(2, 7)), SHAPE)
    got = read_remote(spark, ds, f"file://{tmp_path}/{{r}}-{{t}}-{{c}}-{{cz}}-{{cy}}-{{cx}}", spec, 192)
    assert (dense(got, spec.out_shape) == array[1:2, :, 1:5, 3:9:2, 2:7]).all()
