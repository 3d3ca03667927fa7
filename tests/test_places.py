"""TIFF files by ranges, folders by rounds, and grids in SQL."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from tessella.functions import sql
from tessella.operators import chunked, grid
from tessella.operators.slicing import SliceSpec
from tessella.sources import listing, tiff, tiff_chunks

RNG = np.random.default_rng(9)


@pytest.fixture(scope="module")
def stack(tmp_path_factory):
    """Two times and channels of six planes, in strips of three rows, some deflated."""
    array = RNG.integers(0, 65536, (2, 2, 6, 20, 9)).astype("<u2")
    root = tmp_path_factory.mktemp("stack")
    for t, c, z in np.ndindex(2, 2, 6):
        folder = root / f"T{t}" / f"CH{c}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"p{z:03d}.tif").write_bytes(tiff.encode(array[t, c, z], 3, deflate=z % 2 == 1))
    return str(root), array


def dense(chunks, made, head):
    out = np.full((*head, *made.shape), -1.0)
    for r in chunks.collect():
        at = (r["cz"], r["cy"], r["cx"])
        place = tuple(slice(i * k, i * k + k) for i, k in zip(at, made.chunk, strict=True))
        out[(r["t"], r["c"], *place)] = made.decode(r["payload"], r["codec"], at)
    return out


@pytest.mark.parametrize(("depth", "rows"), [(None, 20), (1, 3), (7, 9), (100, 21)])
def test_stack_as_chunks(spark, stack, depth, rows):
    uri, array = stack
    chunks, made = tiff_chunks.read_tiff(spark, uri, depth)
    assert made == chunked.ChunkGrid((6, 20, 9), (1, rows, 9), "uint16")
    assert (dense(chunks, made, (2, 2)) == array).all()
    ds = tiff_chunks.open_tiff(uri, depth)
    assert (ds.T, ds.C, ds.dtype, ds.level(0).chunk) == (2, 2, "uint16", (1, rows, 9))


def test_only_wanted_strips_are_read(stack):
    uri, array = stack
    whole = tiff_chunks.TiffReader(uri, 3)
    rows = [r for p in whole.partitions() for b in whole.read(p) for r in b.to_pylist()]
    assert len(rows) == 24 * 7
    some = tiff_chunks.TiffReader(uri, 3)
    left = list(some.pushFilters([EqualTo(("t",), 1), EqualTo(("c",), 0), In(("cz",), (2, 4)), EqualTo(("cy",), 1), EqualTo(("n",), 3)]))
    assert len(left) == 1
    found = [r for p in some.partitions() for b in some.read(p) for r in b.to_pylist()]
    assert [(r["t"], r["c"], r["cz"], r["cy"]) for r in found] == [(1, 0, 2, 1), (1, 0, 4, 1)]
    assert all(np.frombuffer(r["payload"], "<u2").reshape(3, 9).tolist() == array[1, 0, r["cz"], 3:6].tolist() for r in found)
    strips, tags = 2 * 3 * 9 * 2, 2 * (8 + 2 + 9 * (8 + 4) + 2 * 7 * 4 + 4)
    assert strips < some.bytes_read <= strips + tags < whole.bytes_read / 10


def test_slices_of_tiff_chunks_push_down(spark, stack):
    uri, array = stack
    chunks, made = tiff_chunks.read_tiff(spark, uri, 3)
    spec = SliceSpec.of((1, 0, slice(1, 4), slice(4, 11), slice(2, 9, 2)), array.shape)
    got, small = chunked.slice_chunks(chunks, made, spec, (2, 4, 4))
    assert (dense(got, small, (1, 1)) == array[1:2, 0:1, 1:4, 4:11, 2:9:2]).all()


def test_files_of_several_pages_and_what_differs(spark, tmp_path):
    planes = RNG.integers(0, 256, (3, 5, 4)).astype("u1")

    def paged(parts):
        """Pages one behind the other, each as ``encode`` makes it, their places moved."""
        import struct

        out, ends = bytearray(), []
        for p in parts:
            data = bytearray(tiff.encode(p))
            at = struct.unpack("<I", data[4:8])[0]
            n = struct.unpack("<H", data[at : at + 2])[0]
            for i in range(n):
                entry = at + 2 + 12 * i
                if struct.unpack("<H", data[entry : entry + 2])[0] == tiff.OFFSETS:
                    data[entry + 8 : entry + 12] = struct.pack("<I", struct.unpack("<I", data[entry + 8 : entry + 12])[0] + len(out))
            if ends:
                out[ends[-1] : ends[-1] + 4] = struct.pack("<I", len(out) + at)
            ends.append(len(out) + at + 2 + 12 * n)
            out += data
        return bytes(out)

    (tmp_path / "a.tif").write_bytes(paged(planes))
    chunks, made = tiff_chunks.read_tiff(spark, str(tmp_path / "a.tif"))
    assert (dense(chunks, made, (1, 1))[0, 0] == planes).all() and made.dtype == "uint8"
    assert [r["cz"] for r in chunks.where("cz = 2").collect()] == [2]
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.tif").write_bytes(tiff.encode(planes[0]))
    (folder / "b.tif").write_bytes(tiff.encode(planes[0][:3]))
    with pytest.raises(Exception, match="differs in shape"):
        tiff_chunks.read_tiff(spark, str(folder))[0].collect()
    with pytest.raises(ValueError, match="no TIFF"):
        tiff_chunks.Stack(str(tmp_path / "none"))


# folders


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k in range(40):
        folder = root / f"d{k % 5}" / f"e {k % 3}" / ("f" * (k % 4) or "g")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"file{k}.txt").write_text("x" * k)
    (root / "empty" / "emptier").mkdir(parents=True)
    (root / "top.bin").write_bytes(b"123")
    os.symlink(root, root / "d0" / "back")  # leads to itself
    os.symlink(root / "top.bin", root / "d1" / "link.bin")
    return root


def test_walk_is_that_of_the_system(spark, tree):
    entries = listing.walk(spark, str(tree)).cache()
    want_dirs, want_files, counts = set(), {}, {}
    for folder, dirs, files in os.walk(tree):
        below = os.path.relpath(folder, tree).replace(".", "", 1) if folder == str(tree) else os.path.relpath(folder, tree)
        counts[below] = (len(dirs), len(files))
        want_dirs |= {os.path.join(below, d) for d in dirs}
        want_files |= {os.path.join(below, f): os.path.getsize(os.path.join(folder, f)) for f in files}
    rows = entries.collect()
    assert {r["path"] for r in rows if r["is_dir"]} == want_dirs and {r["path"]: r["size"] for r in rows if not r["is_dir"]} == want_files
    assert len(rows) == len(want_dirs) + len(want_files) and all(r["listed"] and r["depth"] == r["path"].count("/") + 1 for r in rows)
    assert {r["path"] for r in rows if r["link"]} == {"d0/back", "d1/link.bin"}
    assert all(r["modified"] is not None and (r["parent"] + "/" + r["name"]).lstrip("/") == r["path"] for r in rows)
    assert {r["path"]: (r["dirs"], r["files"]) for r in listing.folder_counts(entries).collect()} == counts
    shallow = listing.walk(spark, str(tree), 1)
    assert {r["path"] for r in shallow.collect()} == {r["path"] for r in rows if r["depth"] == 1}


def test_walk_of_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "bare").mkdir()
    assert listing.walk(spark, str(tmp_path / "bare")).count() == 0
    assert [r["path"] for r in listing.walk(spark, str(tmp_path)).collect()] == ["bare"]
    assert listing.walk(spark, str(tmp_path / "none")).count() == 0


def test_folders_that_cannot_be_listed_are_named(tmp_path, monkeypatch):
    import pyarrow as pa

    (tmp_path / "a").mkdir()
    got = [r for b in listing._list(iter([pa.RecordBatch.from_pydict({"path": ["gone/away", ""]})]), str(tmp_path)) for r in b.to_pylist()]
    assert [(r["path"], r["listed"]) for r in got] == [("gone/away", False), ("a", True)]


# SQL


def test_sql_grids_are_those_of_the_operators(spark):
    names = sql.register(spark)
    assert "chunk_grid" in names
    sizes = ["t_size", "c_size", "z_size", "y_size", "x_size"]
    levels = spark.createDataFrame([(k, 1, 2, 5 + k, 9, 3 * k + 1) for k in range(6)], ", ".join(["level long", *(f"{s} long" for s in sizes)]))
    levels.createOrReplaceTempView("levels")
    got = spark.sql(f"SELECT g.*, level FROM levels, LATERAL chunk_grid({', '.join(sizes)}, 1, 1, 4, 8, 2) g")
    want = grid.enumerate_grid(levels, (1, 1, 4, 8, 2)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 30
    assert spark.sql("SELECT * FROM chunk_grid(0, 1, 1, 1, 1, 1, 1, 1, 1, 1)").count() == 0 and spark.sql("SELECT * FROM chunk_grid(NULL::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1, 1)").count() == 0
    for bad in ("chunk_grid(1, 2)", "chunk_grid(1, 1, 1, 1, 1, 1, 1, 1, 1, 0)", "chunk_grid(1, 1, 1, 1, 'x', 1, 1, 1, 1, 1)"):
        with pytest.raises(AnalysisException, match="chunk_grid takes"):
            spark.sql(f"SELECT * FROM {bad}")


def test_sql_names_and_boxes(spark):
    sql.register(spark)
    axes = spark.sql("SELECT n, p.* FROM (SELECT n, chunk_axis(n, 4L) AS a FROM VALUES (10L), (0L), (4L) AS v(n)) LATERAL VIEW inline(a) p AS number, low, high")
    assert sorted(map(tuple, axes.collect())) == [(4, 0, 0, 4), (10, 0, 0, 4), (10, 1, 4, 8), (10, 2, 8, 10)]
    row = spark.sql("SELECT chunk_name(0, 1, 2, 3, 4) AS a, chunk_of_name('0.1.2.3.4') AS b, box_name(0, 1, 2, 3, 4, 5) AS c, box_of_name('4-5_2-3_0-1') AS d, halo_box(8, 16, 17, 2) AS e").first()
    assert (row["a"], tuple(row["b"]), row["c"], tuple(row["d"]), tuple(row["e"])) == ("0.1.2.3.4", (0, 1, 2, 3, 4), "4-5_2-3_0-1", (4, 5, 2, 3, 0, 1), (6, 17, 2, 1))
    start, stop = [F.lit(0), F.lit(2), F.lit(4)], [F.lit(1), F.lit(3), F.lit(5)]
    assert spark.range(1).select(grid.box_name(start, stop)).first()[0] == row["c"]
