"""HDF5 and Imaris files: fixtures written by hand, files of the writer, and what is not read."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from tessella.model import ArrayDataset, Level, UnsupportedDtype
from tessella.operators import chunked, encode, reduce
from tessella.sources import config, hdf5, hdf5_virtual, hdf5_write, imaris
from tessella.sources.hdf5 import Hdf5Error, Hdf5File

NOWHERE = (1 << 64) - 1


def new_style(dtype, layout, extra=(), data=b"", links=None):
    """A file with a superblock of version 2 and headers of version 2, byte by byte: one array ``/d`` of 3 x 2 x 2."""

    def message(kind, body, flags=0):
        return struct.pack("<BHB", kind, len(body), flags) + body

    def header(messages):
        body = b"".join(messages)
        return b"OHDR" + bytes([2, 1]) + struct.pack("<H", len(body)) + body + b"\0\0\0\0"

    space = struct.pack("<BBBBQQQ", 2, 3, 0, 1, 3, 2, 2)
    out = bytearray(48)
    place = len(out)
    out += data
    array = len(out)
    out += header([message(1, space), message(3, dtype), message(8, layout(place, len(data))), *(message(*m) for m in extra)])
    root = len(out)
    out += header(links(array) if links else [message(2, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), message(6, struct.pack("<BBB", 1, 0, 1) + b"d" + struct.pack("<Q", array))])
    out[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, NOWHERE, len(out), root, 0)
    return bytes(out)


LE16 = struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 2, 0, 16)
BE16 = struct.pack("<BBBBIHH", 0x10, 1, 0, 0, 2, 0, 16)
VALUES = np.arange(12).reshape(3, 2, 2) * 1000


def contiguous(place, size):
    return struct.pack("<BBQQ", 3, 1, place, size)


def saved(tmp_path, data, name="f.h5"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def blocks(chunks, chunk, shape):
    """The array of z, y, x that rows of a chunk table hold."""
    out = np.zeros(shape)
    for r in chunks.collect():
        block = np.frombuffer(r["payload"], {"uint8": "u1", "uint16": "<u2", "float32": "<f4", "float64": "<f8"}[r["dtype"]]).reshape(chunk)
        low = [r[f"c{a}"] * k for a, k in zip("zyx", chunk, strict=True)]
        part = out[tuple(slice(b, b + k) for b, k in zip(low, chunk, strict=True))]
        part[...] = block[tuple(slice(n) for n in part.shape)]
    return out


@pytest.mark.parametrize(("dtype", "code"), [(LE16, "<u2"), (BE16, ">u2")])
def test_contiguous_array_of_a_new_style_file(spark, tmp_path, dtype, code):
    uri = saved(tmp_path, new_style(dtype, contiguous, data=VALUES.astype(code).tobytes()))
    file = Hdf5File(uri)
    assert list(file.links(file.root)) == ["d"] and (file.array("d") == VALUES).all()
    rows = hdf5.read_hdf5(spark, uri, "/d")
    assert (blocks(rows, (3, 2, 2), (3, 2, 2)) == VALUES).all() and rows.count() == 1


def test_compact_and_unwritten_arrays(tmp_path):
    held = VALUES.astype("<u2").tobytes()
    uri = saved(tmp_path, new_style(LE16, lambda place, size: struct.pack("<BBH", 3, 0, len(held)) + held))
    assert (Hdf5File(uri).array("d") == VALUES).all()
    uri = saved(tmp_path, new_style(LE16, lambda place, size: struct.pack("<BBQQ", 3, 1, NOWHERE, 0), [(5, struct.pack("<BBIH", 3, 32, 2, 77))]))
    assert (Hdf5File(uri).array("d") == 77).all()


def one_chunk(filters, packed, mask=0):
    """Chunks of 2 x 2 x 2 under a tree of one leaf: the second is half beyond the end."""

    def layout(place, size):
        return struct.pack("<BBBQ4I", 3, 2, 4, place, 2, 2, 2, 2)

    def data(place):
        head = 24 + 2 * 48 + 40
        key = lambda n, z: struct.pack("<II4Q", n, mask, z, 0, 0, 0)
        return (b"TREE" + struct.pack("<BBHQQ", 1, 0, 2, NOWHERE, NOWHERE) + key(len(packed[0]), 0) + struct.pack("<Q", place + head)
                + key(len(packed[1]), 2) + struct.pack("<Q", place + head + len(packed[0])) + key(0, 4) + packed[0] + packed[1])

    return new_style(LE16, layout, [(0xB, filters)] if filters else [], data(48))


def test_chunks_with_and_without_filters(spark, tmp_path):
    whole = np.zeros((4, 2, 2), "<u2")
    whole[:3] = VALUES
    raw = [whole[:2].tobytes(), whole[2:].tobytes()]
    shuffled = [np.frombuffer(r, "u1").reshape(-1, 2).T.tobytes() for r in raw]
    v2 = lambda *kinds: struct.pack("<BB", 2, len(kinds)) + b"".join(struct.pack("<HHH", k, 0, len(v)) + struct.pack(f"<{len(v)}I", *v) for k, v in kinds)
    cases = [
        (None, raw, 0),
        (v2((1, [6])), [zlib.compress(r) for r in raw], 0),
        (v2((2, [2]), (1, [6])), [zlib.compress(r) for r in shuffled], 0),
        (v2((2, [2]), (1, [6]), (3, [])), [zlib.compress(r) + b"sum!" for r in shuffled], 0),
        (v2((2, [2]), (1, [6])), shuffled, 2),  # the second filter was skipped
    ]
    for k, (filters, packed, mask) in enumerate(cases):
        uri = saved(tmp_path, one_chunk(filters, packed, mask), f"{k}.h5")
        rows = hdf5.read_hdf5(spark, uri, "d")
        assert (blocks(rows, (2, 2, 2), (3, 2, 2)) == VALUES).all()
        assert [r["cz"] for r in rows.where("cz > 0").collect()] == [1] and sorted(r["n"] for r in rows.collect()) == [4, 8]


def test_what_is_not_read_raises(tmp_path):
    def refused(data, match, kind=Hdf5Error):
        with pytest.raises(kind, match=match):
            d = Hdf5File(saved(tmp_path, data)).dataset("d")
            hdf5.check(d)

    refused(b"not a file of this kind" * 20, "no HDF5 file")
    refused(b"", "no HDF5 file")
    refused(new_style(LE16, lambda place, size: struct.pack("<BB", 4, 2)), "layout of version 4")
    refused(new_style(struct.pack("<BBBBI", 0x19, 0, 0, 0, 16), contiguous), "type of class 9")
    refused(new_style(struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 2, 0, 16), contiguous), "int16", UnsupportedDtype)
    refused(one_chunk(struct.pack("<BB", 2, 1) + struct.pack("<HHHH", 32000, 0, 0, 0), [b"", b""]), "filter 32000")
    refused(new_style(LE16, contiguous, [(5, struct.pack("<BBIH", 3, 32, 2, 7))]), "filled with 7")
    refused(new_style(LE16, contiguous, [(1, b"", 2)]), "shares a message")
    heap = struct.pack("<BHB", 2, 18, 0) + struct.pack("<BBQQ", 0, 0, 4096, NOWHERE)
    refused(new_style(LE16, contiguous, links=lambda array: [heap]), "heap")
    refused(new_style(LE16, contiguous)[:130], "ends within|no object|no d")
    with pytest.raises(Hdf5Error, match="no e"):
        Hdf5File(saved(tmp_path, new_style(LE16, contiguous))).dataset("e")


def test_superblock_behind_a_user_block(tmp_path):
    inner = new_style(LE16, contiguous, data=VALUES.astype("<u2").tobytes())
    moved = bytearray(inner)
    moved[12:20] = struct.pack("<Q", 512)
    assert (Hdf5File(saved(tmp_path, b"\0" * 512 + bytes(moved))).array("d") == VALUES).all()


# the writer's files


def test_old_style_structures(tmp_path):
    """What the writer makes is laid out as the format says: looked at byte by byte, not by the reader."""
    root = hdf5_write.Group()
    for i in range(40):
        root.at(f"g{i:02d}")
    data = hdf5_write.encode(root)
    assert data[:8] == b"\x89HDF\r\n\x1a\n" and data[8:16] == bytes([0, 0, 0, 0, 0, 8, 8, 0]) and struct.unpack("<HH", data[16:20]) == (4, 16)
    end, header, kind, tree, heap = struct.unpack("<Q8x8xQI4xQQ", data[40:96])
    assert end == len(data) and kind == 1
    assert struct.unpack("<BxHI", data[header : header + 8]) == (1, 1, 1) and struct.unpack("<HHB3xQQ", data[header + 16 : header + 40]) == (0x11, 16, 0, tree, heap)
    names = struct.unpack("<Q", data[heap + 24 : heap + 32])[0]
    name = lambda at: data[names + at : data.index(b"\0", names + at)].decode()
    assert data[tree : tree + 8] == b"TREE" + struct.pack("<BBH", 0, 0, 5)
    keys = [struct.unpack("<Q", data[tree + 24 + 16 * k : tree + 32 + 16 * k])[0] for k in range(6)]
    children = [struct.unpack("<Q", data[tree + 32 + 16 * k : tree + 40 + 16 * k])[0] for k in range(5)]
    for k, child in enumerate(children):
        assert data[child : child + 4] == b"SNOD"
        held = [name(struct.unpack("<Q", data[child + 8 + 40 * i : child + 16 + 40 * i])[0]) for i in range(struct.unpack("<H", data[child + 6 : child + 8])[0])]
        assert all(name(keys[k]) < n <= name(keys[k + 1]) for n in held) and len(held) == 8


@pytest.fixture(scope="module")
def volume(spark, tmp_path_factory):
    """One file of two levels, times and channels, with more chunks than one tree node takes."""
    rng = np.random.default_rng(11)
    arrays = {0: rng.integers(0, 65536, (2, 2, 9, 10, 21)), 1: rng.integers(0, 65536, (2, 2, 4, 5, 10))}
    root = hdf5_write.imaris_group(2, 2, (9, 10, 21), (18.0, 5.0, 10.5))
    for r, chunk in ((0, (1, 2, 2)), (1, (2, 5, 4))):
        for t in range(2):
            for c in range(2):
                a = arrays[r][t, c]
                place = root.at(f"DataSet/ResolutionLevel {r}/TimePoint {t}/Channel {c}")
                place.attributes |= {f"ImageSize{x}": str(n) for x, n in zip("ZYX", a.shape, strict=True)} | {"HistogramMin": f"{a.min()}.000", "HistogramMax": f"{a.max()}.000"}
                padded = np.pad(a, [(0, -n % k) for n, k in zip(a.shape, chunk, strict=True)], constant_values=9)  # padding doesn't count
                data = {}
                for at in np.ndindex(*(n // k for n, k in zip(padded.shape, chunk, strict=True))):
                    block = padded[tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, chunk, strict=True))].astype("<u2")
                    data[at] = hdf5_write.pack(np.ascontiguousarray(block).tobytes(), 2)
                place.members["Data"] = hdf5_write.Array(padded.shape, np.dtype("<u2"), chunk, data)
                place.members["Histogram"] = hdf5_write.Array((4,), np.dtype("<u8"), None, np.array([t, c, r, 7], "<u8").tobytes())
    folder = tmp_path_factory.mktemp("imaris")
    (folder / "a.ims").write_bytes(hdf5_write.encode(root))
    return str(folder / "a.ims"), arrays


def test_imaris_is_opened(spark, volume):
    uri, arrays = volume
    ds = imaris.open_imaris(uri)
    assert (ds.T, ds.C, ds.dtype) == (2, 2, "uint16")
    assert ds.levels == (Level(0, (9, 10, 21), (1, 2, 2), (2.0, 0.5, 0.5)), Level(1, (4, 5, 10), (2, 5, 4), (4.5, 1.0, 1.05)))
    assert config.describe(uri) == ds
    for r, a in arrays.items():
        got = np.full(a.shape, -1.0)
        for row in config.open_dataset(spark, uri, r).collect():
            got[row["t"], row["c"], row["z"], row["y"], row["x"]] = row["v"]
        assert (got == a).all()
    assert config.open_dataset(spark, uri, None).groupBy("r").count().orderBy("r").collect() == [(r, a.size) for r, a in arrays.items()]
    with pytest.raises(ValueError, match="level 2"):
        config.open_dataset(spark, uri, 2)


def test_predicates_leave_out_datasets_and_subtrees(spark, volume, monkeypatch):
    uri, arrays = volume
    reader = hdf5.Hdf5Reader(uri, imaris.datasets(uri))
    assert len(list(reader.pushFilters([EqualTo(("r",), 0), EqualTo(("t",), 1), In(("c",), (1,)), GreaterThan(("cz",), 6), LessThanOrEqual(("cx",), 3), EqualTo(("payload",), 3)]))) == 1
    read = []
    real = Hdf5File.at
    monkeypatch.setattr(Hdf5File, "at", lambda self, address, n: read.append(n) or real(self, address, n))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    some = sum(read)
    assert {(r["r"], r["t"], r["c"]) for r in rows} == {(0, 1, 1)}
    assert sorted((r["cz"], r["cy"], r["cx"]) for r in rows) == [(z, y, x) for z in (7, 8) for y in range(5) for x in range(4)]
    read.clear()
    whole = hdf5.Hdf5Reader(uri, imaris.datasets(uri))
    assert len([r for p in whole.partitions() for b in whole.read(p) for r in range(b.num_rows)]) == 4 * (9 * 5 * 11 + 2 * 3)
    assert some < sum(read) / 4
    chunks, grid = imaris.imaris_chunks(spark, uri)
    got = chunked.channel_range(chunks.where("t = 0"), grid).orderBy("c").collect()
    assert [(r["c"], r["vmin"], r["vmax"], r["n"]) for r in got] == [(c, int(a.min()), int(a.max()), a.size) for c, a in enumerate(arrays[0][0])]


def test_large_trees_are_dealt_to_partitions(volume, monkeypatch):
    uri, _ = volume
    monkeypatch.setattr(hdf5, "PARTITION_BYTES", 64 * 8)
    reader = hdf5.Hdf5Reader(uri, imaris.datasets(uri))
    list(reader.pushFilters([EqualTo(("r",), 0)]))
    parts = reader.partitions()
    assert len(parts) == 4 * 8  # 495 chunks are eight leaves
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 4 * 495


def test_stored_histograms_and_ranges(spark, volume):
    uri, arrays = volume
    rows = imaris.stored_histograms(spark, uri).where("r = 1 and t = 0 and c = 1").orderBy("bin").collect()
    low, high = int(arrays[1][0, 1].min()), int(arrays[1][0, 1].max())
    assert [r["n"] for r in rows] == [0, 1, 1, 7] and rows[0]["low"] == low and rows[-1]["high"] == high
    voxels = config.open_dataset(spark, uri, 0)
    known = imaris.stored_ranges(spark, uri).where("c = 0")
    got = {(r["t"], r["c"]): (r["vmin"], r["vmax"], r["computed"]) for r in reduce.stored_range(voxels, known).collect()}
    assert got == {(t, c): (arrays[0][t, c].min(), arrays[0][t, c].max(), c == 1) for t in range(2) for c in range(2)}


def test_slabs_are_files_of_their_own(spark, tmp_path):
    array = np.random.default_rng(5).integers(0, 256, (1, 2, 7, 6, 9)).astype("u1")
    grid = chunked.ChunkGrid((7, 6, 9), (2, 4, 4), "uint8")
    rows = []
    for c in range(2):
        for at in np.ndindex(4, 2, 3):
            block = array[0, c][tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, grid.chunk, strict=True))]
            rows.append((0, 0, c, *at, "uint8", "zlib", grid.encode(block, "zlib", at), block.size))
    chunks = spark.createDataFrame(rows, encode.CHUNK_FIELDS)
    ds = ArrayDataset("s", "uint8", 1, 2, (Level(0, grid.shape, grid.chunk, (2.0, 1.0, 1.0)),))
    made = hdf5_write.write_imaris_slabs(chunks, ds, str(tmp_path / "slabs"), rows=2).orderBy("z").collect()
    assert [(r["z"], r["depth"]) for r in made] == [(0, 4), (4, 3)]
    assert imaris.open_imaris(made[1]["path"]).levels == (Level(0, (3, 6, 9), (2, 4, 4), (2.0, 1.0, 1.0)),)
    both = config.virtual_dataset(spark, [(r["path"], {"z": r["z"]}) for r in made])
    got = np.full(array.shape, -1.0)
    for r in both.collect():
        got[r["t"], r["c"], r["z"], r["y"], r["x"]] = r["v"]
    assert (got == array).all()
    counted = imaris.stored_histograms(spark, made[0]["path"]).groupBy("c").agg(F.sum("n").alias("n")).collect()
    assert {r["c"]: r["n"] for r in counted} == {0: 4 * 54, 1: 4 * 54}
    with pytest.raises(config.MissingDependency):
        config.open_dataset(spark, "x.omehans")
    assert json.dumps(config.describe(str(tmp_path / "none.ims"))) == "null"


# virtual arrays


def hyperslab(version, low, size):
    rank = len(low)
    if version == 1:
        return struct.pack(f"<IIIIII{2 * rank}I", 2, 1, 0, 8 + 8 * rank, rank, 1, *low, *(b + n - 1 for b, n in zip(low, size, strict=True)))
    if version == 2:
        return struct.pack("<IIBII", 2, 2, 0, 4 + 32 * rank, rank) + b"".join(struct.pack("<4Q", b, 1, 1, n) for b, n in zip(low, size, strict=True))
    return struct.pack("<IIBBI", 2, 3, 1, 4, rank) + b"".join(struct.pack("<4I", b, n // 2, 2, n // 2) if n % 2 == 0 else struct.pack("<4I", b, 1, 1, n) for b, n in zip(low, size, strict=True))


def virtual_file(shape, entries):
    """A file whose array ``vdata`` of that shape lists sources: (file, dataset, serialized selections)."""

    def message(kind, body):
        return struct.pack("<BHB", kind, len(body), 0) + body

    def header(messages):
        body = b"".join(messages)
        return b"OHDR" + bytes([2, 1]) + struct.pack("<H", len(body)) + body + b"\0\0\0\0"

    block = struct.pack("<BQ", 0, len(entries)) + b"".join(f.encode() + b"\0" + d.encode() + b"\0" + s for f, d, s in entries) + b"sum!"
    other = struct.pack("<HH4xQ", 1, 1, 5) + b"other\0\0\0"
    kept = struct.pack("<HH4xQ", 2, 1, len(block)) + block + b"\0" * (-len(block) % 8)
    heap = b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(other) + len(kept)) + other + kept
    out = bytearray(48)
    place = len(out)
    out += heap
    array = len(out)
    out += header([message(1, struct.pack("<BBBB5Q", 2, 5, 0, 1, *shape)), message(3, LE16), message(8, struct.pack("<BBQI", 4, 3, place, 2))])
    root = len(out)
    out += header([message(6, struct.pack("<BBB", 1, 0, 5) + b"vdata" + struct.pack("<Q", array))])
    out[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQI", 3, 8, 8, 0, 0, NOWHERE, len(out), root, 0)
    return bytes(out)


EVERYTHING = struct.pack("<IIII", 3, 1, 0, 0)


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    """Level 0: a shard of three axes for each time, channel and four planes; level 1: one shard of five axes."""
    root = tmp_path_factory.mktemp("vds")
    array = np.random.default_rng(4).integers(1, 65536, (2, 2, 10, 6, 7)).astype("<u2")
    small = np.random.default_rng(5).integers(1, 65536, (2, 2, 5, 3, 4)).astype("<u2")

    def packed(a, chunk):
        padded = np.pad(a, [(0, -n % k) for n, k in zip(a.shape, chunk, strict=True)])
        data = {}
        for at in np.ndindex(*(n // k for n, k in zip(padded.shape, chunk, strict=True))):
            data[at] = hdf5_write.pack(np.ascontiguousarray(padded[tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, chunk, strict=True))]).tobytes(), 2)
        return hdf5_write.Array(a.shape, np.dtype("<u2"), chunk, data)

    entries = []
    for k, (t, c, z) in enumerate((t, c, z) for t in range(2) for c in range(2) for z in range(0, 10, 4)):
        part = array[t, c, z : z + 4]
        file = hdf5_write.Group()
        file.members["data"] = packed(part, (2, 4, 4))
        (root / f"s{k}.h5").write_bytes(hdf5_write.encode(file))
        low, size = (t, c, z, 0, 0), (1, 1, *part.shape)
        entries.append((f"s{k}.h5", "/data", (EVERYTHING if k % 2 else hyperslab(1, (0, 0, 0), part.shape)) + hyperslab(1 + k % 3, low, size)))
    (root / "VDS_0.hf").write_bytes(virtual_file(array.shape, entries))
    file = hdf5_write.Group()
    file.members["all"] = packed(small, (1, 1, 2, 2, 4))
    (root / "deep.h5").write_bytes(hdf5_write.encode(file))
    (root / "VDS_1.hf").write_bytes(virtual_file(small.shape, [(str(root / "deep.h5"), "all", EVERYTHING + EVERYTHING)]))
    return str(root), array, small


def test_virtual_arrays_are_opened_and_read(spark, shards):
    uri, array, small = shards
    ds = hdf5_virtual.open_virtual(uri)
    assert (ds.T, ds.C, ds.dtype) == (2, 2, "uint16")
    assert ds.levels == (Level(0, (10, 6, 7), (2, 4, 4), (50.0, 1.0, 1.0)), Level(1, (5, 3, 4), (2, 2, 4), (100.0, 2.0, 2.0)))
    for r, a in enumerate((array, small)):
        got = np.zeros(a.shape)
        for row in hdf5_virtual.virtual_voxels(spark, uri, r).collect():
            got[row["t"], row["c"], row["z"], row["y"], row["x"]] = row["v"]
        assert (got == a).all()


def test_predicates_leave_out_shards(shards):
    uri, *_ = shards
    reader = hdf5_virtual.VirtualReader(uri)
    list(reader.pushFilters([EqualTo(("r",), 0), EqualTo(("t",), 1), GreaterThan(("cz",), 2), EqualTo(("cy",), 0)]))
    parts = reader.partitions()
    assert sorted((p.source.low[1], p.source.low[2]) for p in parts) == [(c, z) for c in range(2) for z in (4, 8)]
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["t"], r["c"], r["cz"], r["cy"], r["cx"]) for r in rows) == [(1, c, z, 0, x) for c in range(2) for z in (3, 4) for x in range(2)]


def test_virtual_arrays_that_are_not_read(tmp_path, shards):
    def refused(entries, match, shape=(1, 1, 4, 4, 4)):
        with pytest.raises(Hdf5Error, match=match):
            (tmp_path / "VDS_0.hf").write_bytes(virtual_file(shape, entries))
            hdf5_virtual.sources_of(str(tmp_path / "VDS_0.hf"))

    two = struct.pack("<IIIIII12I", 2, 1, 0, 0, 3, 2, *range(12))
    refused([("a", "b", two + EVERYTHING)], "selects 2 blocks")
    refused([("a", "b", struct.pack("<IIII", 1, 1, 0, 0) + EVERYTHING)], "kind 1")
    refused([("a", "b", hyperslab(2, (1, 0, 0), (4, 4, 4)) + EVERYTHING)], "part of its array")
    refused([("a", "b", hyperslab(2, (0, 0, 0), (2, 4, 4)) + EVERYTHING)], "part of its array")
    with pytest.raises(Hdf5Error, match="no virtual array"):
        hdf5_virtual.level_files(str(tmp_path / "none"))
    with pytest.raises(Hdf5Error, match="no vdata"):
        hdf5_virtual.sources_of(saved(tmp_path, new_style(LE16, contiguous), "x.h5"))
