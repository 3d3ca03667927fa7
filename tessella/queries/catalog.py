"""Queries on names, paths, listings, access and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, grid, reduce
from ..session import load
from .common import ENTRIES, Query, file_entries, plain, sql

QUERIES: dict[str, tuple[Query, str | None]] = {}
DATASET = "(" + " OR ".join(f"suffix(lower(name), '{k}')" for k in text.DATASET_TYPES) + ")"


def query(sql_text: str | None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = (lambda spark, sf_dir: plain(fn(spark, sf_dir)), sql_text)
        return fn

    return add


def entries(body: str, longs: str = "", doubles: str = "", rest: str = "") -> str:
    return sql(body, longs, doubles, rest, (ENTRIES,))


BYTES = "(n_chars * n_chars * 37)"


@query(sql(f"SELECT doc_id, round_even(CASE WHEN b > 1024.0 ** 3 THEN b / 1024.0 ** 3 WHEN b > 1024.0 ** 2 THEN b / 1024.0 ** 2 WHEN b > 1024 THEN b / 1024.0::DOUBLE ELSE b END, 2) AS number, CASE WHEN b > 1024.0 ** 3 THEN 'GB' WHEN b > 1024.0 ** 2 THEN 'MB' WHEN b > 1024 THEN 'KB' ELSE 'B' END AS unit, CASE WHEN b > 1024.0 ** 3 THEN 3 WHEN b > 1024.0 ** 2 THEN 2 WHEN b > 1024 THEN 1 ELSE 0 END AS rank FROM (SELECT doc_id, {BYTES} AS b FROM documents)", "doc_id rank", "number", "unit"))
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, unit, rank = text.human_size(F.col("n_chars") * F.col("n_chars") * 37)
    return load(spark, sf_dir, "documents").select("doc_id", number.alias("number"), unit.alias("unit"), rank.alias("rank"))


@query(sql(f"SELECT doc_id, CASE WHEN {BYTES} / 1e9 <= 0.1 THEN {BYTES} END AS size FROM documents", "doc_id size"))
def downloadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.downloadable(F.col("n_chars") * F.col("n_chars") * 37, 0.1).alias("size"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS label FROM events")
def time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", text.time_label(F.col("ts")).alias("label"))


@query(entries("SELECT doc_id, replace(path, ' ', '%20') AS url, regexp_replace(path || '/', '^/|/$', '', 'g') AS stripped, array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), ';') AS parts FROM entries", "doc_id", rest="url stripped parts"))
def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return file_entries(spark, sf_dir).select("doc_id", text.url_escape(path).alias("url"), text.strip_slashes(F.concat(path, F.lit("/"))).alias("stripped"), F.array_join(text.path_parts(path), ";").alias("parts"))


@query(entries(f"SELECT doc_id, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, {DATASET} AS opens FROM entries", "doc_id", rest="ext opens"))
def ext_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_entries(spark, sf_dir).select("doc_id", text.extension(F.concat("path", F.lit("/"))).alias("ext"), text.has_extension(F.col("path")).alias("opens"))


NATURAL = "array_to_string(list_transform(regexp_extract_all({0}, '([0-9]+|[^0-9]+)'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(p, 20, '0') ELSE p END), '')"


@query(entries(f"SELECT parent, name, rank() OVER (PARTITION BY parent ORDER BY {NATURAL.format('name')}) AS place FROM entries", "place", rest="parent name"))
def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.numbered(file_entries(spark, sf_dir).select("parent", "name"), ["parent"], [text.natural_key(F.col("name"))], ties=True)


@query("SELECT p_partkey, lower(translate(p_name || ' - ' || p_type || '.v:' || p_size, ' -.:', '____')) AS label, '#' || upper(substr(md5(p_name), 1, 6)) AS color FROM part")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" - "), "p_type", F.lit(".v:"), "p_size")
    return load(spark, sf_dir, "part").select("p_partkey", text.label(name).alias("label"), text.color(F.substring(F.md5("p_name"), 1, 6)).alias("color"))


@query(entries("SELECT doc_id, md5('slice|' || path || '|' || size) AS key, substr(md5('slice|' || path || '|' || size), 1, 2) || '/' || substr(md5('slice|' || path || '|' || size), 3, 2) || '/' || md5('slice|' || path || '|' || size) AS place FROM entries", "doc_id", rest='"key" place'))
def cache_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, place = text.fingerprint(F.lit("slice"), F.col("path"), F.col("size").cast("string"))
    return file_entries(spark, sf_dir).select("doc_id", key.alias("key"), place.alias("place"))


@query(entries("SELECT doc_id, request, CASE doc_id % 6 WHEN 0 THEN 'chunk' WHEN 1 THEN 'precomputed_chunk' WHEN 2 THEN 'zarray' WHEN 3 THEN 'info' WHEN 4 THEN 'missing' ELSE 'dataset' END AS kind, contains(request, '.8bit.') AS force8, contains(request, '.ng.ome.zarr') AS combine FROM (SELECT doc_id, replace(path, ' ', '_') || CASE doc_id % 6 WHEN 0 THEN '.8bit.ome.zarr/0.0.1.3.14' WHEN 1 THEN '/0/0-64_0-64_0-1' WHEN 2 THEN '.ng.ome.zarr/0/.zarray' WHEN 3 THEN '/info' WHEN 4 THEN '/labels/0' ELSE '' END AS request FROM entries)", "doc_id", rest="request kind force8 combine"))
def resource_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 6
    end = F.when(kind == 0, ".8bit.ome.zarr/0.0.1.3.14").when(kind == 1, "/0/0-64_0-64_0-1").when(kind == 2, ".ng.ome.zarr/0/.zarray").when(kind == 3, "/info").when(kind == 4, "/labels/0").otherwise("")
    request = file_entries(spark, sf_dir).select("doc_id", F.concat(F.replace("path", F.lit(" "), F.lit("_")), end).alias("request"))
    flags = text.virtual_flags(F.col("request"))
    return request.select("doc_id", "request", text.resource(F.col("request")).alias("kind"), flags["force8"].alias("force8"), flags["combine_channels"].alias("combine"))


def _link(service: str, end: str) -> str:
    return f"CASE WHEN {DATASET} THEN 'https://x/{service}' || replace(path, ' ', '%20') || '{end}' END"


VIEWS = {"neuroglancer": _link("ng", ""), "neuroglancer_metadata": _link("ng", "/info")} | {f"omezarr{'_8bit' * b}{'_neuroglancer_optimized' * n}": _link("omezarr", f"{'.ng' * n}{'.8bit' * b}.ome.zarr") for b in (0, 1) for n in (0, 1)}
CHECKED = {f"{k}_validator": f"'https://ome.github.io/ome-ngff-validator/?source=' || {v}" for k, v in VIEWS.items() if k.startswith("omezarr")}
MORE = {f"omezarr{b}_metadata": _link("omezarr", f"{e}.ome.zarr/.zattrs") for b, e in (("", ""), ("_8bit", ".8bit"))} | {"browser": "'https://x/browser' || replace(path, ' ', '%20')", "path": "path"}


@query(entries(f"SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in (VIEWS | CHECKED | MORE).items())} FROM entries", "doc_id", rest=" ".join(VIEWS | CHECKED | MORE)))
def link_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = catalog.link_bundle(F.col("path"), F.lit("https://x"))
    return file_entries(spark, sf_dir).select("doc_id", *(links[k].alias(k) for k in VIEWS | CHECKED | MORE))


SHAPED = "SELECT doc_id, '/lab/v.' || (doc_id % 9 + 1) || 'x256' || CASE WHEN doc_id % 3 = 0 THEN 'x64' ELSE '' END || '.zarr/0' AS a, '/0/1/' || doc_id % 7 || '/' || doc_id % 11 || '/' || doc_id AS b FROM documents"


@query(f"""SELECT doc_id, a || replace('/' || substr(b, 2), '/', '.') IS NOT NULL AS ok, a || '/' || replace(substr(b, 2), '/', '.') AS dotted, a || b AS slashed,
    CASE WHEN doc_id % 3 = 0 THEN '1,1,' || (doc_id % 9 + 1) || ',256,64' ELSE '1,1,1,' || (doc_id % 9 + 1) || ',256' END AS chunk FROM ({SHAPED})""")
def chunk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.concat(F.lit("/lab/v."), k % 9 + 1, F.lit("x256"), F.when(k % 3 == 0, "x64").otherwise(""), F.lit(".zarr/0/0/1/"), k % 7, F.lit("/"), k % 11, F.lit("/"), k)
    dotted = load(spark, sf_dir, "documents").select(k, grid.dotted_path(name).alias("dotted"))
    chunk = F.array_join(grid.chunk_in_path(F.col("dotted")), ",")
    return dotted.select("doc_id", F.col("dotted").isNotNull().alias("ok"), "dotted", grid.slashed_path(F.col("dotted")).alias("slashed"), chunk.alias("chunk"))


@query(entries("SELECT parent, count(*) FILTER (is_dir) AS dirs, count(*) FILTER (NOT is_dir) AS files FROM entries GROUP BY parent", "dirs files", rest="parent"))
def listing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.listing_counts(file_entries(spark, sf_dir))


@query(entries(f"SELECT path, NOT is_dir OR {DATASET} AS is_file, CASE WHEN is_dir THEN 0 WHEN size > 1024 THEN round_even(size / 1024.0::DOUBLE, 2) ELSE size END AS size_number, CASE WHEN NOT is_dir AND size > 1024 THEN 'KB' ELSE 'B' END AS size_unit, CASE WHEN {DATASET} THEN '/ng' || path END AS ng_link FROM entries", "", "size_number", "path is_file size_unit ng_link"))
def dir_as_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.listing(file_entries(spark, sf_dir)).select("path", "is_file", "size_number", "size_unit", "ng_link")


@query(entries("SELECT path, array_to_string(list_filter(string_split(parent, '/'), lambda p: p <> ''), '>') AS trail FROM entries", "", rest="path trail"))
def listing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.transform("parents", lambda p: F.element_at(F.split(p, "/"), -1))
    return catalog.listing(file_entries(spark, sf_dir)).select("path", F.array_join(last, ">").alias("trail"))


@query(entries("SELECT path FROM entries WHERE NOT is_dir AND lower(regexp_extract(name, '(\\.[^./]*)$', 1)) IN ('.ims', '.tif')", rest="path"))
def type_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(".ims",), (".tif",)], "ext string")
    files = file_entries(spark, sf_dir).where("not is_dir").withColumn("ext", text.extension(F.col("name")))
    return files.join(F.broadcast(kinds), "ext", "left_semi").select("path")


@query("SELECT source AS collection, count(DISTINCT lang) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS names FROM documents GROUP BY source")
def curated_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = load(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("lang").alias("name"), F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("url"))
    out = catalog.collections(members)
    return out.select("collection", F.size("datasets").alias("n"), F.array_join(F.transform("datasets", lambda d: d["name"]), ",").alias("names"))


#: Users are customers, groups their nations; every 50th is in "all". Roots are market segments.
ACL = """users AS (SELECT lower('U' || c_custkey) AS usr, lower('N' || c_nationkey) AS grp, c_custkey % 50 = 0 AS everything FROM customer),
allowed AS (SELECT usr, usr AS a FROM users UNION SELECT usr, grp FROM users),
roots AS (SELECT 'R' || r_regionkey AS root, r_regionkey = 0 AS anonymous, r_regionkey <> 1 AS restricted FROM region),
folders AS (SELECT 'R' || n_regionkey AS root, lower('N' || n_nationkey) AS folder FROM nation)"""


def _access(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    customer = load(spark, sf_dir, "customer")
    member = customer.select(F.concat(F.lit("U"), "c_custkey").alias("user"), F.concat(F.lit("N"), "c_nationkey").alias("group"))
    special = customer.where("c_custkey % 50 = 0").select(F.concat(F.lit("U"), "c_custkey").alias("user"))
    allowed = catalog.allowed_names(member.unionByName(special.withColumn("group", F.lit("All"))))
    k = F.col("r_regionkey")
    roots = load(spark, sf_dir, "region").select(F.concat(F.lit("R"), k).alias("root"), (k == 0).alias("anonymous"), (k != 1).alias("restricted"))
    folders = load(spark, sf_dir, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("root"), F.concat(F.lit("n"), "n_nationkey").alias("folder"))
    return roots, folders, allowed, special


OPEN = "SELECT root FROM roots WHERE anonymous OR NOT restricted"


@query(f"""WITH {ACL} SELECT DISTINCT allowed.usr AS "user", root FROM allowed JOIN folders ON folder = a WHERE root NOT IN ({OPEN}) AND allowed.usr NOT IN (SELECT usr FROM users WHERE everything)
    UNION SELECT NULL, root FROM ({OPEN}) UNION SELECT usr, NULL FROM users WHERE everything""")
def acl_visible_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roots_of_users(*_access(spark, sf_dir))


@query(f"""WITH {ACL}, asked AS (SELECT 'U' || c_custkey AS "user", lower('U' || c_custkey) AS usr, 'R' || ((c_custkey + d) % 5) AS root, c_custkey % 50 = 0 AS everything FROM customer, (SELECT unnest(range(0, 2)) AS d))
    SELECT "user", root FROM asked WHERE everything OR root IN ({OPEN}) OR EXISTS (SELECT 1 FROM allowed JOIN folders ON folder = a WHERE allowed.usr = asked.usr AND folders.root = asked.root)""")
def acl_may_enter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = load(spark, sf_dir, "customer").select(F.concat(F.lit("U"), k).alias("user"), F.explode(F.array(*(F.concat(F.lit("R"), (k + d) % 5) for d in range(2)))).alias("root"))
    return catalog.may_enter(asked, catalog.roots_of_users(*_access(spark, sf_dir)))


@query(f"WITH {ACL} SELECT DISTINCT usr AS \"user\", a AS allowed FROM allowed")
def acl_group_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _access(spark, sf_dir)[2]


@query(entries("SELECT path FROM entries WHERE string_split(path, '/')[3] IN ('en', 'fr')", rest="path"))
def acl_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("u1", "en"), ("u1", "fr")], "user string, allowed string")
    return catalog.subtree_filter(file_entries(spark, sf_dir), allowed, segment=2).select("path")


@query("SELECT 'R' || r_regionkey AS name, r_name AS path FROM region WHERE r_regionkey % 2 = 0")
def anonymous_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = load(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("name"), F.col("r_name").alias("path"), (F.col("r_regionkey") % 2 == 1).alias("is_auth"))
    return catalog.visible_roots(roots, False).drop("is_auth")


@query(entries("SELECT path, CASE WHEN starts_with(path, '/src1/en/') THEN '/src1/en' WHEN starts_with(path, '/src1/') THEN '/src1' WHEN starts_with(path, '/src2/') THEN '/src2' END AS root, CASE WHEN starts_with(path, '/src1/en/') THEN '/data/english' || substr(path, 9) WHEN starts_with(path, '/src1/') THEN '/data/one' || substr(path, 6) WHEN starts_with(path, '/src2/') THEN '/mnt/2' || substr(path, 6) END AS mapped FROM entries", rest="path root mapped"))
def path_map_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = spark.createDataFrame([("/src1", "/data/one"), ("/src1/en", "/data/english"), ("/src2", "/mnt/2")], "prefix string, target string")
    return catalog.longest_root(file_entries(spark, sf_dir).select("path"), roots)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def index_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


LOG = "log AS (SELECT user_id % 10 AS shard, user_id AS k, ts, event_id FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("shard"), F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))


@query(f"WITH {LOG} SELECT event_id AS id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY k ORDER BY ts, event_id)) <= 900 * 1000000, false) AS hit FROM log")
def cache_hits_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ttl_hits(_log(spark, sf_dir), 900).select("id", "hit")


@query(f"WITH {LOG} SELECT event_id AS id, CAST(n - lag(n) OVER (PARTITION BY shard, k ORDER BY n) AS BIGINT) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, event_id) AS n FROM log)")
def cache_lru_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reuse_distance(_log(spark, sf_dir)).select("id", "distance")


@query(entries("SELECT substr(md5(path), 1, 2) AS a, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM entries GROUP BY a", "n bytes", rest="a"))
def cache_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_entries(spark, sf_dir).groupBy(F.substring(F.md5("path"), 1, 2).alias("a")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' END AS by_key, CASE lower(p_brand) WHEN 'brand#13' THEN 'third' WHEN 'brand#14' THEN 'fourth' END AS by_value FROM part")
def dict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.create_map(*(F.lit(x) for x in ("Brand#11", "first", "Brand#12", "second")))
    back = F.create_map(*(F.lit(x) for x in ("third", "BRAND#13", "fourth", "brand#14")))
    part = load(spark, sf_dir, "part")
    return part.select("p_partkey", text.lookup(keys, F.col("p_brand")).alias("by_key"), text.lookup(back, F.col("p_brand")).alias("by_value"))
