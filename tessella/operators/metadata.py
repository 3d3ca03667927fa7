"""Metadata documents of arrays, as columns and as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ArrayDataset, dtype_code

#: Colours of channels, in turn.
COLORS = ("FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF")


def level_translation(levels: DataFrame) -> DataFrame:
    """``levels`` (dataset, r, res) with the offset of each: the finer level's voxel size where they differ, else 0."""
    before = F.lag("res").over(Window.partitionBy("dataset").orderBy("r"))
    ratio = F.col("res") / before
    return levels.withColumn("translation", F.when(F.col("r") == 0, 0.0).when(ratio != 1, F.col("res") / ratio).otherwise(0.0))


def zarray(levels: DataFrame, combine_channels: bool = False, codec: str | None = None) -> DataFrame:
    """``levels`` (dtype_code, T, C, Z, Y, X, kz, ky, kx) with the ``.zarray`` document. The compressor is named as it is: null, zlib or zstd."""
    compressor = F.struct(F.lit(codec).alias("id"), F.lit(3 if codec == "zstd" else 6).alias("level")) if codec else F.lit(None).cast("struct<id:string,level:int>")
    doc = F.struct(
        F.array(F.lit(1), F.col("C") if combine_channels else F.lit(1), "kz", "ky", "kx").alias("chunks"),
        compressor.alias("compressor"),
        F.lit("/").alias("dimension_separator"),
        F.col("dtype_code").alias("dtype"),
        F.lit(0).alias("fill_value"),
        F.lit(None).cast("string").alias("filters"),
        F.lit("C").alias("order"),
        F.array("T", "C", "Z", "Y", "X").alias("shape"),
        F.lit(2).alias("zarr_format"),
    )
    return levels.withColumn("zarray", F.to_json(doc, {"ignoreNullFields": "false"}))


def zgroup() -> str:
    return json.dumps({"zarr_format": 2})


def zattrs(ds: ArrayDataset, channels: Sequence[dict]) -> dict:
    """The ``.zattrs`` document. ``channels``: vmin, vmax and optionally start, end, label, color, active, in order."""
    axes = [{"name": "t", "type": "time", "unit": "millisecond"}, {"name": "c", "type": "channel"}] + [{"name": a, "type": "space", "unit": "micrometer"} for a in "zyx"]
    datasets, before = [], None
    for level in ds.levels:
        scale = [1.0, 1.0, *level.resolution]
        moved = [0.0, 0.0] + [0.0 if before is None or a == b else b for a, b in zip(level.resolution, before or level.resolution, strict=True)]
        datasets.append({"path": str(level.r), "coordinateTransformations": [{"type": "scale", "scale": scale}, {"type": "translation", "translation": moved}]})
        before = level.resolution
    top = 65535 if ds.dtype == "uint16" else 255 if ds.dtype == "uint8" else 1
    shown = []
    for i, c in enumerate(channels):
        start, end = c.get("start", c["vmin"]) or 0, c.get("end", c["vmax"])
        end = top if end is None else end
        low, high = (max(0, int(start // 2)), min(top, int(end * 2))) if ds.dtype.startswith("uint") else (0.0, 1.0)
        shown.append({"active": c.get("active", True), "coefficient": 1, "color": c.get("color", COLORS[i % len(COLORS)]), "family": "linear", "inverted": False, "label": c.get("label", f"channel{i}"), "window": {"start": start, "end": end, "min": low, "max": high}})
    return {
        "_creator": {"name": "tessella", "version": "1"},
        "multiscales": [{"axes": axes, "datasets": datasets, "version": "0.4", "type": "gaussian", "metadata": {"method": "block mean"}}],
        "omero": {"id": 1, "name": ds.name, "version": "0.4", "channels": shown, "rdefs": {"defaultT": 0, "defaultZ": ds.level(0).shape[0] // 2, "model": "color"}},
    }


def precomputed_info(levels: DataFrame) -> DataFrame:
    """dataset and its ``info`` document from levels (dataset, dtype, C, r, Z, Y, X, kz, ky, kx, res_z, res_y, res_x in micrometres)."""
    zero = F.array(F.lit(0), F.lit(0), F.lit(0))
    scale = F.struct(
        "r",
        F.struct(
            F.array(F.array("kx", "ky", "kz")).alias("chunk_sizes"),
            F.lit("raw").alias("encoding"),
            F.col("r").cast("string").alias("key"),
            F.array(*(F.col(f"res_{a}") * 1000 for a in "xyz")).alias("resolution"),
            F.array("X", "Y", "Z").alias("size"),
            zero.alias("voxel_offset"),
        ).alias("scale"),
    )
    by = levels.groupBy("dataset", "dtype", "C").agg(F.array_sort(F.collect_list(scale)).alias("s"))
    doc = F.struct(F.col("dtype").alias("data_type"), F.col("C").alias("num_channels"), F.lit("image").alias("type"), F.transform("s", lambda s: s["scale"]).alias("scales"))
    return by.select("dataset", F.to_json(doc).alias("info"))


def shader(channels: Sequence[dict]) -> str:
    """Shader text: a checkbox, a range control and a colour for each channel, summed and clamped at 1.

    Labels become names of controls; of equal ones all but the first get their channel's number. A lone channel needs no
    channel number in its range control.
    """
    lines, terms, taken = [], [], set()
    for i, c in enumerate(channels):
        name = c.get("label", f"channel{i}").translate(str.maketrans(" -.:", "____")).lower()
        name = f"{name}_{i}" if name in taken else name
        taken.add(name)
        lines.append(f"#uicontrol bool {name}_visible checkbox(default={str(bool(c.get('active', True))).lower()});")
        lines.append(f'#uicontrol vec3 {name}_color color(default="#{c.get("color", COLORS[i % len(COLORS)]).upper()}");')
        lines.append(f"#uicontrol invlerp {name}(range=[{c['vmin']}, {c['vmax']}], window=[{c.get('low', 0)}, {c.get('high', 65535)}]{f', channel={i}' if len(channels) > 1 else ''});")
        terms.append(f"    if ({name}_visible) total += {name}_color * {name}();")
    return "\n".join([*lines, "void main() {", "    vec3 total = vec3(0.0);", *terms, "    emitRGB(min(total, vec3(1.0)));", "}"])


def viewer_link(viewer: str, source: str, ds: ArrayDataset, shader_text: str) -> str:
    """A viewer's URL with the state after ``#!``; a source that is not secure is shown by a viewer that is not either."""
    base = viewer if "https://" in source or "://" not in source else viewer.replace("https://", "http://", 1)
    return f"{base.rstrip('/')}/#!{quote(viewer_state(source, ds, shader_text), safe='')}"


def viewer_state(source: str, ds: ArrayDataset, shader_text: str) -> str:
    """State of a viewer link as JSON: coordinate space in metres, xy layout."""
    z, y, x = ds.level(0).resolution
    shape = ds.level(0).shape
    space = {"x": [x * 1e-6, "m"], "y": [y * 1e-6, "m"], "z": [z * 1e-6, "m"]}
    layer = {"type": "image", "source": source if "://" in source else f"precomputed://{source}", "name": ds.name, "shader": shader_text}
    return json.dumps({"dimensions": space, "position": [n / 2 for n in shape[::-1]], "crossSectionScale": 50, "projectionScale": 600 * max(shape), "layers": [layer], "layout": "xy"})


def metadata_map(ds: ArrayDataset) -> dict[str, object]:
    """The core fields and, for each level, time and channel, shape, chunks and resolution under ``(r, t, c, 'field')``."""
    out: dict[str, object] = {"shape": ds.shape(), "chunks": ds.chunks(), "dtype": ds.dtype, "ndim": 5, "ResolutionLevels": len(ds.levels), "TimePoints": ds.T, "Channels": ds.C}
    for level in ds.levels:
        for t in range(ds.T):
            for c in range(ds.C):
                for name, value in (("shape", ds.shape(level.r)), ("chunks", ds.chunks(level.r)), ("resolution", level.resolution)):
                    out[str((level.r, t, c, name))] = value
    return out


def codes(dtypes: Sequence[str]) -> dict[str, str]:
    return {d: dtype_code(d) for d in dtypes}
