"""Dataset catalogs: mounted roots, access, listings, links, collections, and what caches would do for an access log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_extension, human_size, natural_key, time_label
from ..session import materialize

#: Fields of a link bundle, the service each belongs to and what follows the path.
LINKS = {
    "neuroglancer": ("ng", ""),
    "neuroglancer_metadata": ("ng", "/info"),
    "omezarr": ("omezarr", ".ome.zarr"),
    "omezarr_metadata": ("omezarr", ".ome.zarr/.zattrs"),
    "omezarr_8bit": ("omezarr", ".8bit.ome.zarr"),
    "omezarr_8bit_metadata": ("omezarr", ".8bit.ome.zarr/.zattrs"),
    "omezarr_neuroglancer_optimized": ("omezarr", ".ng.ome.zarr"),
    "omezarr_8bit_neuroglancer_optimized": ("omezarr", ".ng.8bit.ome.zarr"),
    "metadata": ("metadata", ""),
    "info": ("info", ""),
    "download": ("dl", ""),
    "browser": ("browser", ""),
    "browser_json": ("browser_json", ""),
}
#: Fields whose URL a validator takes; its own field is named after it.
VALIDATED = ("omezarr", "omezarr_8bit", "omezarr_neuroglancer_optimized", "omezarr_8bit_neuroglancer_optimized")
VALIDATOR = "https://ome.github.io/ome-ngff-validator/?source="
#: Services for any path, dataset or not.
ANY_PATH = ("browser", "browser_json", "dl")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place", ties: bool = False) -> DataFrame:
    """``rows`` with their number (from 1) in the order within each of ``keys``; with ``ties`` equal ones share the first's.

    Rows are dealt to tasks by ranges of keys and order, so that a key may have any number of them: a task numbers its own,
    and counts of the ranges before (a row a key and range) are added.
    """
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    # the row travels as one column, so that none of its names can clash with those used here
    keyed = [quoted(k).alias(f"key{i}") for i, k in enumerate(keys)]
    own = rows.select(F.struct(*map(quoted, rows.columns)).alias("row"), *keyed, *(c.alias(f"order{i}") for i, c in enumerate(order)))
    by, of = [f"order{i}" for i in range(len(order))], [f"key{i}" for i in range(len(keys))]
    dealt = materialize(own.repartitionByRange(*of, *by).withColumn("part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*of).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*of, "part").agg(F.count("*").alias("n")).select(*of, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy(*of, "part").orderBy(*by)
    local = dealt.withColumn("local", F.rank().over(within) if ties else F.row_number().over(within))
    same = [local[k].eqNullSafe(counts[k]) for k in [*of, "part"]]
    out = local.join(counts, reduce(lambda a, b: a & b, same))
    return out.select(*(F.col("row").getField(c).alias(c) for c in rows.columns), (F.col("local") + F.col("earlier")).alias(name))


def visible_roots(roots: DataFrame, authenticated: bool) -> DataFrame:
    """``roots`` (name, path, is_auth): all of them for authenticated users, else the anonymous ones."""
    return roots if authenticated else roots.where(~F.col("is_auth"))


def allowed_names(memberships: DataFrame) -> DataFrame:
    """user and each name that opens folders for it: the user and its groups, lower-cased; the group "all" is a matter of its own."""
    m = memberships.select(F.lower("user").alias("user"), F.lower("group").alias("group"))
    return m.where(F.col("group") != "all").select("user", F.col("group").alias("allowed")).union(m.select("user", "user")).distinct()


def roots_of_users(roots: DataFrame, folders: DataFrame, allowed: DataFrame, all_users: DataFrame) -> DataFrame:
    """(user, root), where a null user stands for everyone and a null root for every root, so that nothing grows with
    users times roots: roots that are open or unrestricted, for everyone; roots with a folder named for a user or one of its
    groups; and every root for users of the group "all". ``roots``: root, anonymous, restricted; ``folders``: root, folder."""
    everyone = roots.where(F.col("anonymous") | ~F.col("restricted")).select(F.lit(None).cast("string").alias("user"), "root")
    named = folders.select("root", F.lower("folder").alias("allowed")).distinct().join(allowed, "allowed").join(everyone.select("root"), "root", "left_anti").select("user", "root")
    whole = all_users.select(F.lower("user").alias("user"), F.lit(None).cast("string").alias("root"))
    return named.join(whole.select("user"), "user", "left_anti").union(everyone).union(whole).distinct()


def may_enter(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """``requests`` (user, root, ...) that ``grants`` of ``roots_of_users`` allow."""
    open_ = grants.where("user is null").select("root")
    all_ = grants.where("root is null").select(F.col("user").alias("whole_user"))
    pairs = grants.where("user is not null and root is not null").select(F.col("user").alias("named_user"), F.col("root").alias("named_root"))
    free = requests.join(open_, requests["root"] == open_["root"], "left_semi")
    rest = requests.join(open_, requests["root"] == open_["root"], "left_anti")
    user = F.lower(requests["user"])
    whole = rest.join(all_, user == all_["whole_user"], "left_semi")
    named = rest.join(all_, user == all_["whole_user"], "left_anti").join(pairs, (user == pairs["named_user"]) & (requests["root"] == pairs["named_root"]), "left_semi")
    return free.union(whole).union(named)


def longest_root(paths: DataFrame, roots: DataFrame, path: str = "path", closest: bool = False) -> DataFrame:
    """``paths`` with the longest root (prefix, target) that each begins with and the path below the target.

    Prefixes are joined as whole segments by equality, not compared with every root. With ``closest`` a path below no root
    is mapped by the longest root whose segments stand anywhere in it, from where they stand.
    """
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.select(path).distinct().withColumn("prefix", F.explode(heads)).join(roots, "prefix")
    best = found.groupBy(path).agg(F.max_by(F.struct("prefix", "target"), F.length("prefix")).alias("best"))
    out = paths.join(best, path, "left").select(*paths.columns, "best", F.lit(1).alias("at"))
    if closest:
        # every run of segments of the path, in place of the heads alone
        inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, i, n), "/")).alias("prefix"), (F.length(F.array_join(F.slice(parts, 1, i - 1), "/")) + 1).alias("at")))))
        rest = out.where("best is null").select(path).distinct().where(F.size(parts) > 1).select(path, F.explode(inner).alias("run")).select(path, "run.prefix", "run.at").join(roots, "prefix")
        near = rest.groupBy(path).agg(F.max_by(F.struct("prefix", "target", "at"), F.struct(F.length("prefix"), -F.col("at"))).alias("near"))
        out = out.join(near, path, "left").select(*paths.columns, F.coalesce("best", F.struct("near.prefix", "near.target")).alias("best"), F.coalesce("near.at", F.lit(1)).alias("at"))
    mapped = F.concat("best.target", F.expr(f"substr({path}, length(best.prefix) + at)"))
    return out.select(*paths.columns, F.col("best.prefix").alias("root"), mapped.alias("mapped"))


def subtree_filter(entries: DataFrame, allowed: DataFrame, open_access: bool = False, segment: int = 3) -> DataFrame:
    """Entries whose ``segment``-th path part is an allowed name; all with ``open_access``."""
    if open_access:
        return entries
    part = F.lower(F.element_at(F.filter(F.split("path", "/"), lambda p: p != ""), segment))
    names = allowed.select(F.col("allowed").alias("allowed_part")).distinct()
    return entries.join(names, part == names["allowed_part"], "left_semi")


def listing(entries: DataFrame) -> DataFrame:
    """``entries`` (path, parent, name, is_dir, size, modified) as a listing: directories that are datasets count as files of
    size 0; how many entries a folder has, sizes, times, parents, links. ``listing_order`` sorts it."""
    dataset = has_extension(F.col("name"))
    as_file = ~F.col("is_dir") | dataset
    number, unit, rank = human_size(F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size")))
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    inside = entries.groupBy("parent").agg(F.count("*").alias("entries")).select(F.col("parent").alias("path"), "entries")
    counted = entries.join(inside, "path", "left")
    return counted.select(
        "path", "parent", "name", as_file.alias("is_file"), number.alias("size_number"), unit.alias("size_unit"), rank.alias("size_sort"),
        time_label(F.col("modified")).alias("modified"), F.when(F.size(parts) > 1, parents).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.when(dataset, F.concat(F.lit("/ng"), "path")).alias("ng_link"), F.when(F.col("is_dir"), F.coalesce("entries", F.lit(0))).alias("entries"),
    )


def listing_order() -> list[Column]:
    """Within a folder: folders first, names in natural order."""
    return [F.col("parent"), F.col("is_file"), natural_key(F.col("name")), F.col("name")]


def link_bundle(path: Column, base: Column, authenticated: bool = True, is_auth: Column | None = None) -> dict[str, Column]:
    """A URL for each kind of view of a dataset, and its path; null where the path is no dataset.

    Links are made for all roots, so that they can be shared; with ``authenticated`` false those under a root of ``is_auth`` are null.
    """
    clean = F.regexp_replace(path, "(?<=.)/$", "")
    opens = has_extension(clean)
    shown = F.lit(True) if authenticated or is_auth is None else ~is_auth
    out = {"path": clean}
    for name, (service, end) in LINKS.items():
        url = F.replace(F.concat(base, F.lit(f"/{service}"), clean, F.lit(end)), F.lit(" "), F.lit("%20"))
        out[name] = F.when(shown & (opens | F.lit(service in ANY_PATH)), url)
    return out | {f"{name}_validator": F.concat(F.lit(VALIDATOR), out[name]) for name in VALIDATED}


def collections(members: DataFrame) -> DataFrame:
    """collection and its datasets (name, url) in order of name; ``members``: collection, name, url."""
    return members.groupBy("collection").agg(F.array_sort(F.collect_set(F.struct("name", "url"))).alias("datasets"))


def ttl_hits(log: DataFrame, seconds: int) -> DataFrame:
    """``log`` (key, ts, id) with ``hit``: the key was asked for within ``seconds`` before (a hit renews it)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(at).over(Window.partitionBy("key").orderBy("ts", "id"))
    return log.withColumn("hit", F.coalesce(at - before <= seconds * 1_000_000, F.lit(False)))


def reuse_distance(log: DataFrame) -> DataFrame:
    """``log`` (shard, key, ts, id) with the number of accesses in its shard since the key was last asked for, null at first.

    At least as many as the distinct keys among them, so a cache with room for that many would have hit.
    """
    places = numbered(log, ["shard"], [F.col("ts"), F.col("id")], "n")
    before = F.lag("n").over(Window.partitionBy("shard", "key").orderBy("n"))
    return places.withColumn("distance", F.col("n") - before).drop("n")
