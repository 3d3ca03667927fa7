"""Names and paths: sizes, natural order, extensions, labels, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: Extensions that open as datasets.
DATASET_TYPES = (".ims", ".omezarr", ".ome.zarr", ".omezans", ".omehans", ".zarr", ".z_sharded")


def human_size(n: Column) -> tuple[Column, Column, Column]:
    """(number to 2 digits, unit, rank of the unit): divided by 1024 while above 1024, so 1024 stays 1024 B."""
    number, unit, rank = n.cast("double"), F.lit(SIZE_UNITS[0]), F.lit(0)
    for i in range(len(SIZE_UNITS) - 1, 0, -1):
        above = n > F.lit(1024.0 ** i)
        if i == len(SIZE_UNITS) - 1:
            number, unit, rank = F.when(above, n / 1024.0**i), F.when(above, SIZE_UNITS[i]), F.when(above, i)
        else:
            number, unit, rank = number.when(above, n / 1024.0**i), unit.when(above, SIZE_UNITS[i]), rank.when(above, i)
    return F.bround(number.otherwise(n.cast("double")), 2), unit.otherwise(SIZE_UNITS[0]), rank.otherwise(0)


def downloadable(n: Column, limit_gb: float) -> Column:
    """The size where a file may be downloaded, else null; decimal gigabytes."""
    return F.when(n / 1e9 <= limit_gb, n)


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def url_escape(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit("%20"))


def strip_slashes(s: Column) -> Column:
    """Without one leading and one trailing slash."""
    return F.regexp_replace(s, r"^/|/$", "")


def strip_line_ends(s: Column) -> Column:
    return F.regexp_replace(s, r"\n+$", "")


def path_parts(s: Column) -> Column:
    return F.filter(F.split(s, "/"), lambda p: p != "")


def extension(path: Column) -> Column:
    """The last extension, with its dot, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"(\.[^./]*)$", 1))


def has_extension(path: Column, kinds: tuple[str, ...] = DATASET_TYPES) -> Column:
    """Whether the path ends in one of these extensions, of one or several parts, whatever its case."""
    clean = F.lower(F.regexp_replace(path, "/+$", ""))
    return reduce(lambda a, b: a | b, (F.endswith(clean, F.lit(k.lower())) for k in kinds))


def label(s: Column) -> Column:
    """Lower case, with `` -.:`` as ``_``."""
    return F.lower(F.translate(s, " -.:", "____"))


def color(s: Column) -> Column:
    return F.concat(F.lit("#"), F.upper(s))


def natural_key(s: Column, width: int = 20) -> Column:
    """A string whose order is that of s with runs of digits compared as numbers."""
    parts = F.regexp_extract_all(s, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def fingerprint(*parts: Column) -> tuple[Column, Column]:
    """(md5 of the parts, fan-out path ab/cd/hash)."""
    h = F.md5(F.concat_ws("|", *parts))
    return h, F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def virtual_flags(path: Column) -> dict[str, Column]:
    """What extensions inside a path ask for: 8-bit values, all channels in one chunk."""
    return {"force8": path.contains(".8.") | path.contains(".8bit."), "combine_channels": path.contains(".ng.ome.zarr")}


def resource(path: Column) -> Column:
    """What a request path names: chunk, a metadata document, labels or the dataset itself."""
    return (
        F.when(path.rlike(r"(^|/)\d+\.\d+\.\d+\.\d+\.\d+$") | path.rlike(r"(^|/)\d+/\d+/\d+/\d+/\d+$"), "chunk")
        .when(path.rlike(r"(^|/)\d+-\d+_\d+-\d+_\d+-\d+$"), "precomputed_chunk")
        .when(path.rlike(r"(^|/)\.zarray$"), "zarray")
        .when(path.rlike(r"(^|/)\.zattrs$"), "zattrs")
        .when(path.rlike(r"(^|/)\.zgroup$"), "zgroup")
        .when(path.rlike(r"(^|/)info$"), "info")
        .when(path.rlike(r"(^|/)labels(/|$)"), "missing")
        .otherwise("dataset")
    )


def lookup(pairs: Column, wanted: Column, substring: bool = False) -> Column:
    """In a map: the value of the key ``wanted``; else the first key, in order, whose value equals it in any case (or, with
    ``substring``, holds it); else null."""
    low = F.lower(wanted)
    same = F.map_filter(pairs, (lambda k, v: F.contains(F.lower(v), low)) if substring else (lambda k, v: F.lower(v) == low))
    return F.coalesce(F.try_element_at(pairs, wanted), F.array_min(F.map_keys(same)))
