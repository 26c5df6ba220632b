"""Where results leave: tables, JSON, pickles, images; and chunked, resumable stores."""

from __future__ import annotations

import json
import pickle
import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.plans.coverage import Coverage

#: Cells that the driver-side formats (json, pickle, png) take; larger results belong into tables.
DRIVER_CELLS = 4_000_000


def write(c: Coverage, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet, ORC, CSV or JSON lines by the executors, and the metadata beside them as JSON."""
    writer = c.df.write.format(format).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    meta = {"dims": list(c.dims), "outputs": list(c.outputs), "attrs": {k: v for k, v in c.attrs.items() if isinstance(v, (str, int, float, dict, list, type(None)))}}
    c.df.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.meta")


def open_coverage(spark: SparkSession, path: str, format: str = "parquet") -> Coverage:
    meta = json.loads(spark.read.text(f"{path.rstrip('/')}.meta").head()[0])
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    df = reader.format(format).load(path)
    if format == "csv":
        df = df.select(*(F.col(d).cast("timestamp" if d == "time" else "double").alias(d) for d in meta["dims"]), *(F.col(o).cast("double") for o in meta["outputs"]))
    return Coverage(df, tuple(meta["dims"]), tuple(meta["outputs"]), meta["attrs"])


def to_dict(c: Coverage) -> dict:
    """A small result as plain lists, missing as None; rows in order of the dimensions."""
    rows = _rows(c)
    return {"dims": list(c.dims), "outputs": list(c.outputs), "data": {n: [r[n] if not hasattr(r[n], "isoformat") else r[n].isoformat() for r in rows] for n in (*c.dims, *c.outputs)}}


def _rows(c: Coverage) -> list:
    rows = c.df.orderBy(*c.dims).limit(DRIVER_CELLS + 1).collect()
    if len(rows) > DRIVER_CELLS:
        raise ValueError("too many cells for a driver-side format; write a table instead")
    return rows


def to_array(c: Coverage, output: str | None = None) -> np.ndarray:
    """A small grid as a dense array in order of the dimensions, missing as NaN."""
    rows = _rows(c)
    o = output or c.outputs[0]
    axes = [sorted({r[d] for r in rows}) for d in c.dims]
    at = [{v: i for i, v in enumerate(a)} for a in axes]
    out = np.full([len(a) for a in axes], np.nan)
    for r in rows:
        out[tuple(at[k][r[d]] for k, d in enumerate(c.dims))] = np.nan if r[o] is None else r[o]
    return out


def to_png(c: Coverage, lat: str = "lat", lon: str = "lon", vmin: float | None = None, vmax: float | None = None) -> bytes:
    """A grey image, north up, missing cells transparent; the range is given, the style's, or the data's. A style with
    colours of enumerated values ("#rrggbb") gives those, and grey for other values."""
    grid = to_array(c.transpose(lat, lon))
    if grid.ndim > 2 and max(grid.shape[2:]) > 1:
        raise ValueError("an image holds one time and altitude")
    grid = grid.reshape(grid.shape[:2])
    clim = (c.attrs.get("style") or {}).get("clim", (None, None))
    known = grid[~np.isnan(grid)]
    lo = next((v for v in (vmin, clim[0]) if v is not None), known.min() if known.size else 0.0)
    hi = next((v for v in (vmax, clim[1]) if v is not None), known.max() if known.size else 1.0)
    level = np.clip((np.nan_to_num(grid) - lo) / ((hi - lo) or 1.0), 0, 1)[::-1]
    shade = (level * 255).astype(np.uint8)
    pixels = np.stack([shade, shade, shade, np.where(np.isnan(grid[::-1]), 0, 255).astype(np.uint8)], axis=-1)
    for value, colour in ((c.attrs.get("style") or {}).get("enumeration_colors") or {}).items():
        pixels[grid[::-1] == float(value), :3] = list(bytes.fromhex(colour.lstrip("#")))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_geotiff(c: Coverage, path: str) -> None:
    """A raster of lat and lon as a plain TIFF of 64-bit floats with the model tags of GeoTIFF."""
    if not {"lat", "lon"} <= set(c.dims):
        raise ValueError("a GeoTIFF needs lat and lon")
    rows = _rows(c.transpose("lat", "lon"))
    lats, lons = (sorted({r[d] for r in rows}) for d in ("lat", "lon"))
    grid = to_array(c.transpose("lat", "lon"))
    if grid.ndim > 2 and max(grid.shape[2:]) > 1:
        raise ValueError("a GeoTIFF holds one time and altitude")
    grid = grid.reshape(len(lats), len(lons))[::-1]
    dy = (lats[-1] - lats[0]) / max(1, len(lats) - 1) or 1.0
    dx = (lons[-1] - lons[0]) / max(1, len(lons) - 1) or 1.0
    body = grid.astype("<f8").tobytes()
    tags: list[tuple[int, int, bytes]] = []
    num = lambda tag, kind, *v: tags.append((tag, kind, struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(v), *v)))
    num(256, 4, grid.shape[1]); num(257, 4, grid.shape[0]); num(258, 3, 64); num(259, 3, 1); num(262, 3, 1); num(273, 4, 8); num(277, 3, 1)  # noqa: E702
    num(278, 4, grid.shape[0]); num(279, 4, len(body)); num(339, 3, 3); num(33550, 12, dx, dy, 0.0)  # noqa: E702
    num(33922, 12, 0.0, 0.0, 0.0, lons[0] - dx / 2, lats[-1] + dy / 2, 0.0)
    num(34735, 3, 1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    at = 8 + len(body)
    extra = at + 2 + 12 * len(tags) + 4
    entries, tail = b"", b""
    for tag, kind, data in tags:
        count = len(data) // {3: 2, 4: 4, 12: 8}[kind]
        if len(data) <= 4:
            entries += struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, count, extra + len(tail))
            tail += data
    Path(path).write_bytes(struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + tail)


def to_format(c: Coverage, format: str, path: str | None = None):
    """By name: parquet, orc, csv, jsonl (tables), dict, json, pickle, png, tiff; netcdf and hdf5 need xarray."""
    name = format.lower()
    if name in ("parquet", "orc", "csv"):
        return write(c, path, name)
    if name == "jsonl":
        return write(c, path, "json")
    if name == "dict":
        return to_dict(c)
    if name == "json":
        return json.dumps(to_dict(c))
    if name in ("pickle", "pkl"):
        return pickle.dumps(to_dict(c))
    if name in ("png", "image"):
        return to_png(c)
    if name in ("tif", "tiff", "geotiff"):
        return to_geotiff(c, path)
    if name in ("netcdf", "nc", "hdf5", "hdf"):
        from lodegrid.sources.nodes import MissingLibrary

        raise MissingLibrary(f"{format} needs xarray; Parquet with its .meta holds the same")
    raise ValueError(f"unknown format {format!r}")


def chunk_column(df: DataFrame, sizes: dict[str, int], chunk: dict[str, int]):
    """The number of the chunk that a cell's indexes lie in."""
    from lodegrid.plans.coordinates import index_column

    out = F.lit(0).cast("long")
    for d, n in sizes.items():
        step = chunk.get(d, n)
        out = out * -(-n // step) + F.floor(F.col(index_column(d)) / step)
    return out.cast("int")


def written_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk numbers that a store already holds; an empty table for a new one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    numbers = [(int(n.removeprefix("chunk=")),) for n in found if n.startswith("chunk=")]
    return spark.createDataFrame(numbers, T.StructType([T.StructField("chunk", T.IntegerType())]))


def write_missing_chunks(c: Coverage, chunk: F.Column, path: str, skip_existing: bool = True) -> None:
    """Write a coverage partitioned by chunk; chunks in the store stay as they are (or are overwritten one by
    one), so an interrupted run goes on where it stopped."""
    spark = c.df.sparkSession
    df = c.df.withColumn("chunk", chunk)
    if skip_existing:
        df = df.join(F.broadcast(written_chunks(spark, path)), "chunk", "left_anti")
    df.write.mode("append" if skip_existing else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
