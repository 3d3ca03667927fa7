"""Names, listings and access on small hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import catalog


def test_human_size_keeps_1024_bytes(spark):
    df = spark.createDataFrame([(0,), (1024,), (1025,), (1024**2,), (1024**2 + 1,), (5 * 1024**4,)], "n long")
    got = [tuple(r) for r in df.select(*text.human_size(F.col("n"))).collect()]
    assert got == [(0.0, "B", 0), (1024.0, "B", 0), (1.0, "KB", 1), (1024.0, "KB", 1), (1.0, "MB", 2), (5.0, "TB", 4)]


def test_natural_order(spark):
    names = ["a10", "a2", "a1b", "a1", "b", "10", "9", "a02"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(text.natural_key(F.col("n")), "n").collect()] == ["9", "10", "a1", "a1b", "a02", "a2", "a10", "b"]


def test_extensions(spark):
    df = spark.createDataFrame([("/a/b.OME.ZARR/",), ("/a/b.zarr.txt",), ("/a.zarr/b",), ("/a/B.ims",)], "p string")
    assert [r[0] for r in df.select(text.has_extension(F.col("p"))).collect()] == [True, False, False, True]


def test_reuse_and_ttl(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    log = spark.createDataFrame([(0, "a", at(0), 1), (0, "b", at(1), 2), (0, "a", at(2), 3), (1, "a", at(3), 4)], "shard int, key string, ts timestamp, id int")
    assert {r["id"]: r["distance"] for r in catalog.reuse_distance(log).collect()} == {1: None, 2: None, 3: 2, 4: None}
    assert {r["id"] for r in catalog.ttl_hits(log, 60).where("hit").collect()} == {4}


def test_longest_root_needs_whole_segments(spark):
    roots = spark.createDataFrame([("/a", "/x"), ("/a/b", "/y")], "prefix string, target string")
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/d",)], "path string")
    assert {r["path"]: r["mapped"] for r in catalog.longest_root(paths, roots).collect()} == {"/a/b/c": "/y/c", "/a/bc": "/x/bc", "/d": None}


def test_roots_of_users(spark):
    roots = spark.createDataFrame([("open", True, True), ("free", False, False), ("closed", False, True)], "root string, anonymous boolean, restricted boolean")
    folders = spark.createDataFrame([("closed", "LabX")], "root string, folder string")
    members = spark.createDataFrame([("Ann", "labx"), ("bob", "other"), ("cy", "All")], "user string, group string")
    allowed = catalog.allowed_names(members)
    grants = catalog.roots_of_users(roots, folders, allowed, members.where("lower(group) = 'all'").select("user"))
    assert {tuple(r) for r in grants.collect()} == {(None, "open"), (None, "free"), ("ann", "closed"), ("cy", None)}
    asked = spark.createDataFrame([(u, r, 1) for u in ("Ann", "bob", "CY", "dan") for r in ("open", "closed")], "user string, root string, n int")
    got = {(r["user"], r["root"]) for r in catalog.may_enter(asked, grants).collect()}
    assert got == {("Ann", "open"), ("Ann", "closed"), ("bob", "open"), ("CY", "open"), ("CY", "closed"), ("dan", "open")}


def test_closest_root(spark):
    roots = spark.createDataFrame([("/a", "/x"), ("/lab/b", "/y")], "prefix string, target string")
    paths = spark.createDataFrame([("/a/b/c",), ("/mnt/lab/b/c",), ("/mnt/lab/bc",), ("/d",)], "path string")
    got = {r["path"]: (r["root"], r["mapped"]) for r in catalog.longest_root(paths, roots, closest=True).collect()}
    assert got == {"/a/b/c": ("/a", "/x/b/c"), "/mnt/lab/b/c": ("/lab/b", "/y/c"), "/mnt/lab/bc": (None, None), "/d": (None, None)}


def test_links(spark):
    df = spark.createDataFrame([("/lab/a b.ome.zarr/", True), ("/lab/x.txt", False)], "path string, secret boolean")
    every = catalog.link_bundle(F.col("path"), F.lit("https://x"))
    rows = df.select(*(c.alias(k) for k, c in every.items())).collect()
    assert len(every) >= 13 and rows[0]["omezarr_8bit_neuroglancer_optimized_validator"].endswith("source=https://x/omezarr/lab/a%20b.ome.zarr.ng.8bit.ome.zarr")
    assert rows[1]["omezarr"] is None and rows[1]["omezarr_validator"] is None and rows[1]["browser"] == "https://x/browser/lab/x.txt"
    some = catalog.link_bundle(F.col("path"), F.lit("https://x"), authenticated=False, is_auth=F.col("secret"))
    assert [r["browser"] is None for r in df.select(some["browser"].alias("browser")).collect()] == [True, False]


def test_listing(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("/d", "", "d", True, 0), ("/d/a10", "/d", "a10", False, 5), ("/d/a9", "/d", "a9", False, 2048), ("/d/e", "/d", "e", True, 0)]
    df = spark.createDataFrame([(*r, at) for r in rows], "path string, parent string, name string, is_dir boolean, size long, modified timestamp")
    got = catalog.listing(df).orderBy(*catalog.listing_order()).collect()
    assert [(r["name"], r["entries"]) for r in got] == [("d", 3), ("e", 0), ("a9", None), ("a10", None)]


def test_numbers_within_keys(spark):
    rows = spark.createDataFrame([("a" if i % 4 else None, i * 7 % 50 // 3, i) for i in range(200)], "k string, v int, i int").repartition(7)
    got = {r["i"]: r["place"] for r in catalog.numbered(rows, ["k"], [F.col("v"), F.col("i")]).collect()}
    tied = {r["i"]: r["place"] for r in catalog.numbered(rows, ["k"], [F.col("v")], ties=True).collect()}
    for k in ("a", None):
        own = sorted((r["v"], r["i"]) for r in rows.collect() if r["k"] == k)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
        assert all(tied[i] == 1 + sum(w < v for w, _ in own) for v, i in own)


def test_numbering_leaves_columns_alone(spark):
    names = ["__order0", "__n", "order0", "key0", "part", "local", "row", "n", "earlier", "a.b", "a`b", "place "]
    rows = spark.createDataFrame([(i % 3, i, *(f"{n}-{i}" for n in names)) for i in range(30)], ["k", "v", *names])
    got = catalog.numbered(rows, ["k"], [-F.col("v")])
    assert got.columns == [*rows.columns, "place"]
    for r in got.collect():
        assert r["place"] == 10 - r["v"] // 3 and all(r[n] == f"{n}-{r['v']}" for n in names)
    dotted = rows.select("v", F.col("k").alias("k.k"))
    assert {r["v"]: r["place"] for r in catalog.numbered(dotted, ["k.k"], [F.col("v")]).collect()} == {i: i // 3 + 1 for i in range(30)}


def test_filters_by_names_leave_columns_alone(spark):
    entries = spark.createDataFrame([("/a/b/Ann/x", "p", "q"), ("/a/b/bob/x", "r", "s")], "path string, __part string, allowed string")
    allowed = spark.createDataFrame([("ann", "ann"), ("ann", "ann")], "user string, allowed string")
    assert [tuple(r) for r in catalog.subtree_filter(entries, allowed).collect()] == [("/a/b/Ann/x", "p", "q")]
    asked = spark.createDataFrame([("Ann", "r1", "x"), ("bob", "r1", "y"), ("cy", "r2", "z"), ("Di", "r9", "w")], "user string, root string, __user string")
    grants = spark.createDataFrame([("ann", "r1"), (None, "r2"), ("di", None)], "user string, root string")
    assert sorted(tuple(r) for r in catalog.may_enter(asked, grants).collect()) == [("Ann", "r1", "x"), ("Di", "r9", "w"), ("cy", "r2", "z")]
