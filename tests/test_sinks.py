"""Zarr chunks in transactions, and arrays behind a service."""

import io
import json
import threading
import time
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.model import ArrayDataset, Level
from tessella.operators import encode
from tessella.operators.chunked import ChunkGrid
from tessella.sources import remote_array, zarr, zarr_sink

SHAPE, CHUNK = (5, 9, 14), (2, 4, 4)
RNG = np.random.default_rng(21)


def rows_of(array, codec="zstd", cut=False, r=0):
    grid = ChunkGrid(array.shape[2:], CHUNK, "uint16", cut)
    out = []
    for t, c in np.ndindex(*array.shape[:2]):
        for at in np.ndindex(*(-(-n // k) for n, k in zip(grid.shape, CHUNK, strict=True))):
            block = array[t, c][tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, CHUNK, strict=True))]
            out.append((r, t, c, *at, "uint16", codec, grid.encode(block, codec, at), block.size))
    return out


def group(tmp_path, codec="zstd", order="C", separator="/"):
    uri = str(tmp_path / "g.ome.zarr")
    zarr.create_zarr(ArrayDataset("g", "uint16", 1, 2, (Level(0, SHAPE, CHUNK), Level(1, (2, 4, 7), CHUNK))), uri, codec, order=order, separator=separator)
    return uri


def held(spark, uri, shape=(1, 2, *SHAPE), r=0):
    out = np.zeros(shape)
    for row in zarr.read_zarr(spark, uri).where(F.col("r") == r).collect():
        out[row["t"], row["c"], row["z"], row["y"], row["x"]] = row["v"]
    return out


def files(tmp_path):
    return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".z"))


@pytest.mark.parametrize(("codec", "order", "separator", "given", "cut"), [("zstd", "C", "/", "zlib", False), ("blosc", "F", ".", "null", False), ("null", "C", "/", "zstd", True)])
def test_chunks_are_stored_as_the_group_keeps_them(spark, tmp_path, codec, order, separator, given, cut):
    array = RNG.integers(1, 65536, (1, 2, *SHAPE))
    uri = group(tmp_path, codec, order, separator)
    zarr.write_chunks(spark.createDataFrame(rows_of(array, given, cut), encode.CHUNK_FIELDS), uri)
    assert (held(spark, uri) == array).all()
    assert len(files(tmp_path)) == 2 * 3 * 3 * 4 and not list(tmp_path.rglob(".staged*"))


def test_append_replaces_chunks_and_overwrite_levels(spark, tmp_path):
    array = RNG.integers(1, 65536, (1, 2, *SHAPE))
    uri = group(tmp_path)
    whole = spark.createDataFrame(rows_of(array), encode.CHUNK_FIELDS)
    zarr.write_chunks(whole, uri)
    small = RNG.integers(1, 65536, (1, 2, 2, 4, 7))
    zarr.write_chunks(spark.createDataFrame(rows_of(small, r=1), encode.CHUNK_FIELDS), uri)
    other = RNG.integers(1, 65536, (1, 2, *SHAPE))
    some = spark.createDataFrame(rows_of(other), encode.CHUNK_FIELDS).where("c = 1 and cz = 0")
    zarr.write_chunks(some, uri)
    mixed = array.copy()
    mixed[:, 1, :2] = other[:, 1, :2]
    assert (held(spark, uri) == mixed).all()
    zarr.write_chunks(some, uri, overwrite=True)
    left = np.zeros_like(array)
    left[:, 1, :2] = other[:, 1, :2]
    assert (held(spark, uri) == left).all() and (held(spark, uri, (1, 2, 2, 4, 7), 1) == small).all()


def test_a_failed_job_leaves_no_trace(spark, tmp_path):
    array = RNG.integers(1, 65536, (1, 2, *SHAPE))
    uri = group(tmp_path)
    zarr.write_chunks(spark.createDataFrame(rows_of(array), encode.CHUNK_FIELDS).where("cz < 2"), uri)
    before = {f: (tmp_path / f).read_bytes() for f in files(tmp_path)}
    bad = spark.createDataFrame(rows_of(array + 1), encode.CHUNK_FIELDS).repartition(6)
    broken = bad.withColumn("payload", F.when((F.col("cz") == 1) & (F.col("cx") == 2), F.lit(b"no payload")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="zstd|ZSTD|codec|decompress|Unknown frame"):
        zarr.write_chunks(broken, uri)
    outside = bad.withColumn("cx", F.col("cx") + 3)
    with pytest.raises(Exception, match="has no chunk"):
        zarr.write_chunks(outside, uri)
    with pytest.raises(Exception, match="holds uint16"):
        zarr.write_chunks(bad.withColumn("dtype", F.lit("uint8")), uri)
    for _ in range(100):  # tasks that still run when the job has failed
        if not list(tmp_path.rglob(".staged*")):
            break
        time.sleep(0.1)
    assert {f: (tmp_path / f).read_bytes() for f in files(tmp_path)} == before and not list(tmp_path.rglob(".staged*"))


def test_of_doubled_attempts_one_stays(spark, tmp_path):
    array = RNG.integers(1, 65536, (1, 2, *SHAPE))
    uri = group(tmp_path)
    table = spark.createDataFrame(rows_of(array), encode.CHUNK_FIELDS)
    batches = table.toArrow().to_batches()
    writer = zarr_sink.ZarrWriter(uri, table.schema, False)
    first, second = writer.write(iter(batches)), writer.write(iter(batches))
    zeros = spark.createDataFrame(rows_of(array * 0), encode.CHUNK_FIELDS).toArrow().to_batches()
    writer.write(iter(zeros))  # an attempt that Spark didn't take
    assert first.folder != second.folder and first.chunks == 72 and first.bytes == second.bytes
    assert len(files(tmp_path)) == 3 * 72 + 1
    writer.commit([second, None, zarr_sink.Staged("none", 0, 0)])
    assert (held(spark, uri) == array).all() and len(files(tmp_path)) == 72 and not list(tmp_path.rglob(".staged*"))
    again = zarr_sink.ZarrWriter(uri, table.schema, False)
    again.write(iter(zeros))
    again.abort([None])
    with pytest.raises(RuntimeError, match="has ended"):
        again.write(iter(zeros))
    assert (held(spark, uri) == array).all() and not list(tmp_path.rglob(".staged*"))
    with pytest.raises(ValueError, match="payload"):
        zarr_sink.ZarrWriter(uri, table.drop("payload").schema, False)


# a service


@pytest.fixture
def service():
    """An array behind HTTP: what it was asked, and answers that fail the first time."""
    array = RNG.integers(0, 65536, (2, 2, *SHAPE)).astype("<u2")
    half = array[..., ::2, ::2, ::2]
    asked, failed = [], set()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            asked.append(self.path)
            if self.path not in failed and "cstart=1" in self.path:
                failed.add(self.path)
                self.send_error(503)
                return
            if url.path.startswith("/metadata/"):
                meta = {"ResolutionLevels": 2, "TimePoints": 2, "Channels": 2}
                for r, a in enumerate((array, half)):
                    for t, c in np.ndindex(2, 2):
                        meta |= {f"({r}, {t}, {c}, 'shape')": [1, 1, *a.shape[2:]], f"({r}, {t}, {c}, 'chunks')": [1, 1, *CHUNK], f"({r}, {t}, {c}, 'dtype')": "uint16", f"({r}, {t}, {c}, 'resolution')": [1.0, 0.5, 0.5]}
                body = json.dumps(meta).encode()
            elif url.path == "/array/gone":
                self.send_error(404)
                return
            else:
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                a = (array, half)[int(q["res"])]
                out = io.BytesIO()
                np.save(out, a[tuple(slice(int(q[f"{x}start"]), int(q[f"{x}stop"])) for x in "tczyx")])
                body = zlib.compress(out.getvalue())
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/array/brain", (array, half), asked
    server.shutdown()


def test_a_service_tells_what_it_holds(service):
    url, (array, half), _ = service
    ds = remote_array.describe_remote(url)
    assert (ds.T, ds.C, ds.dtype) == (2, 2, "uint16") and [level.shape for level in ds.levels] == [array.shape[2:], half.shape[2:]]
    assert ds.level(0).chunk == CHUNK and ds.level(0).resolution == (1.0, 0.5, 0.5)


def test_predicates_become_the_requests(spark, service):
    url, (array, _), asked = service
    got = np.zeros(array.shape)
    grid = ChunkGrid(SHAPE, CHUNK, "uint16")
    rows = remote_array.read_remote_array(spark, url, "zlib").where("r = 0 and t = 1 and cz >= 1 and cx in (0, 3)").collect()
    assert sorted((r["c"], r["cz"], r["cy"], r["cx"]) for r in rows) == [(c, z, y, x) for c in range(2) for z in (1, 2) for y in range(3) for x in (0, 3)]
    for r in rows:
        at = (r["cz"], r["cy"], r["cx"])
        place = tuple(slice(i * k, i * k + k) for i, k in zip(at, CHUNK, strict=True))
        got[(r["t"], r["c"], *place)] = grid.decode(r["payload"], r["codec"], at)
    want = np.zeros(array.shape)
    for x in (slice(0, 4), slice(12, 14)):
        want[1, :, 2:, :, x] = array[1, :, 2:, :, x]
    assert (got == want).all()
    requests = [a for a in asked if a.startswith("/array")]
    assert len(set(requests)) == len(rows) and len(requests) == len(rows) * 3 // 2  # half of them failed once
    assert all("res=0" in a and "tstart=1" in a and "tstop=2" in a for a in requests)


def test_voxels_of_a_level_and_what_is_gone(spark, service):
    url, (_, half), _ = service
    got = np.full(half.shape, -1.0)
    for r in remote_array.remote_voxels(spark, url, 1, "zlib").collect():
        got[r["t"], r["c"], r["z"], r["y"], r["x"]] = r["v"]
    assert (got == half).all()
    with pytest.raises(Exception, match="404"):
        remote_array.read_remote_array(spark, url.replace("brain", "gone"), "zlib").collect()


def test_retries_end(monkeypatch):
    calls = []

    def broken(url, timeout):
        calls.append(url)
        raise OSError("no route")

    monkeypatch.setattr(remote_array.urllib.request, "urlopen", broken)
    with pytest.raises(OSError, match="no route"):
        remote_array.fetch("http://x", tries=3, wait=0.0)
    assert len(calls) == 3


def test_renames_go_over_what_is_there(tmp_path):
    """As on file systems that refuse to rename onto a file."""
    from pyarrow import fs as pafs

    from tessella.sources.stores import rename_over

    class Refusing:
        def __init__(self):
            self.fs = pafs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, old, new):
            if self.fs.get_file_info(new).type != pafs.FileType.NotFound:
                raise OSError("exists")
            self.fs.move(old, new)

    (tmp_path / "a").write_text("new")
    (tmp_path / "b").write_text("old")
    rename_over(Refusing(), str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_text() == "new" and not (tmp_path / "a").exists()
    with pytest.raises(OSError):
        rename_over(Refusing(), str(tmp_path / "a"), str(tmp_path / "c"))


def test_scratch_folders_are_their_own(spark, tmp_path):
    from tessella.session import discard, materialize, scratch_path

    one, two = scratch_path(spark, "x.ome.zarr"), scratch_path(spark, "x.ome.zarr")
    assert one != two and one.endswith("/x.ome.zarr")
    table = materialize(spark.range(3), "three")
    from pathlib import Path

    folder = Path(table._scratch.removeprefix("file://")).parent
    assert folder.exists() and table.count() == 3
    discard(table)
    assert not folder.exists()
