"""Chunked array stores (Zarr, formats 2 and 3) read by the executors.

Chunk files are rows of Spark's binary source, so any file system that Spark knows will do, and a task
decodes the chunks that it is dealt. The driver reads the small JSON texts and the one-dimensional
coordinate arrays only. Codecs: none, zlib, gzip and zstd; others raise.
"""

from __future__ import annotations

import gzip
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.plans import files

_KINDS = {"float64": "<f8", "float32": "<f4", "int64": "<i8", "int32": "<i4", "int16": "<i2", "int8": "<i1", "uint64": "<u8", "uint32": "<u4", "uint16": "<u2", "uint8": "<u1", "bool": "|b1"}


class UnknownCodec(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    """What an array's metadata say: shape, chunks, type, codecs in the order of decoding, fill value, order, chunk names."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codecs: tuple[str, ...]
    fill: float
    order: str
    separator: str
    prefix: str
    dims: tuple[str, ...]
    attributes: dict

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(math.ceil(n / c) for n, c in zip(self.shape, self.chunks, strict=True))

    def decode(self, content: bytes | None) -> np.ndarray:
        """The values of one chunk; a chunk that is not stored holds the fill value."""
        if content is None:
            return np.full(self.chunks, self.fill)
        for codec in self.codecs:
            if codec == "zstd":
                import zstandard

                content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
            else:
                content = gzip.decompress(content) if codec == "gzip" else zlib.decompress(content)
        values = np.frombuffer(content, self.dtype).reshape(self.chunks, order=self.order).astype(float)
        return values if np.isnan(self.fill) else np.where(values == self.fill, np.nan, values) if self.attributes.get("_FillValue") is not None else values


def _fill(v: object) -> float:
    return math.nan if v is None or v == "NaN" else math.inf if v == "Infinity" else -math.inf if v == "-Infinity" else float(v)


def parse_layout(meta: dict, attributes: dict | None = None) -> Layout:
    """From the text of ``.zarray`` (with ``.zattrs``) or ``zarr.json``."""
    if meta.get("zarr_format") == 3:
        codecs = [c["name"] for c in meta["codecs"]]
        little = [c.get("configuration", {}).get("endian", "little") == "little" for c in meta["codecs"] if c["name"] == "bytes"]
        kind = _KINDS[meta["data_type"]]
        keys = meta.get("chunk_key_encoding", {"name": "default"})
        default = keys["name"] == "default"
        separator = keys.get("configuration", {}).get("separator", "/" if default else ".")
        attributes = meta.get("attributes", {})
        layout = (meta["shape"], meta["chunk_grid"]["configuration"]["chunk_shape"], kind if all(little) else kind.replace("<", ">"), [c for c in codecs[::-1] if c not in ("bytes", "crc32c")], meta.get("fill_value"), "C")
        if "crc32c" in codecs:
            raise UnknownCodec("crc32c")
        dims = meta.get("dimension_names") or attributes.get("_ARRAY_DIMENSIONS") or ()
        prefix = f"c{separator}" if default else ""
    else:
        attributes = attributes or {}
        if meta.get("filters"):
            raise UnknownCodec(str(meta["filters"]))
        codec = meta.get("compressor")
        layout = (meta["shape"], meta["chunks"], meta["dtype"], [codec["id"]] if codec else [], meta.get("fill_value"), meta.get("order", "C"))
        dims, prefix, separator = attributes.get("_ARRAY_DIMENSIONS", ()), "", meta.get("dimension_separator", ".")
    shape, chunks, dtype, codecs, fill, order = layout
    if bad := set(codecs) - {"zlib", "gzip", "zstd"}:
        raise UnknownCodec(", ".join(sorted(bad)))
    return Layout(tuple(shape), tuple(chunks), dtype, tuple(codecs), _fill(fill), order, separator, prefix, tuple(dims), attributes)


class Store:
    """A store in a folder, or in memory ({name: bytes})."""

    def __init__(self, spark: SparkSession, source: str | dict[str, bytes]):
        self.spark, self.source = spark, source

    def text(self, name: str) -> dict | None:
        if isinstance(self.source, dict):
            return json.loads(self.source[name]) if name in self.source else None
        found = files.read_text(self.spark, f"{self.source.rstrip('/')}/{name}")
        return None if found is None else json.loads(found)

    def keys(self) -> list[str]:
        """The names of the arrays."""
        if isinstance(self.source, dict):
            return sorted({n.rpartition("/")[0] for n in self.source if n.endswith(("/.zarray", "/zarr.json"))})
        return files.folders(self.spark, self.source)

    def layout(self, key: str) -> Layout:
        if (meta := self.text(f"{key}/.zarray")) is not None:
            return parse_layout(meta, self.text(f"{key}/.zattrs"))
        if (meta := self.text(f"{key}/zarr.json")) is not None:
            return parse_layout(meta)
        raise KeyError(f"no array {key!r} among {self.keys()}")

    def chunks(self, key: str, layout: Layout) -> DataFrame:
        """(chunk, content): a row for each chunk of the grid, in row-major numbers; null where none is stored."""
        every = self.spark.range(math.prod(layout.grid)).withColumnRenamed("id", "chunk")
        if isinstance(self.source, dict):
            rows = [(n, bytearray(b)) for n, b in self.source.items() if n.startswith(f"{key}/")]
            stored = self.spark.createDataFrame(rows, "path string, content binary")
        else:
            stored = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.source.rstrip('/')}/{key}").select("path", "content")
        dot = "\\." if layout.separator == "." else "/"
        number = f"{dot}".join(["(\\d+)"] * len(layout.shape))
        pattern = f"/{layout.prefix.replace('.', dot)}{number}$" if layout.shape else "/0$"
        at = F.lit(0).cast("long")
        for k, n in enumerate(layout.grid):
            at = at * n + F.regexp_extract("path", pattern, k + 1).cast("long")
        return every.join(stored.where(F.col("path").rlike(pattern)).select(at.alias("chunk"), "content"), "chunk", "left")

    def cells(self, key: str, layout: Layout, output: str) -> DataFrame:
        """(__i_0, __i_1, ..., output): the array's cells by index, missing as NaN."""
        names = [*(f"__i_{k}" for k in range(len(layout.shape))), output]
        schema = T.StructType([*(T.StructField(n, T.LongType()) for n in names[:-1]), T.StructField(output, T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    start = [i * c for i, c in zip(np.unravel_index(number, layout.grid), layout.chunks, strict=True)]
                    size = [min(c, n - s) for c, n, s in zip(layout.chunks, layout.shape, start, strict=True)]
                    values = layout.decode(content)[tuple(slice(n) for n in size)]
                    index = np.meshgrid(*(np.arange(s, s + n) for s, n in zip(start, size, strict=True)), indexing="ij")
                    yield pa.RecordBatch.from_arrays([*(pa.array(i.ravel().astype("int64")) for i in index), pa.array(np.ascontiguousarray(values).ravel())], names=names)

        return self.chunks(key, layout).mapInArrow(run, schema)

    def axis(self, key: str) -> tuple[np.ndarray, Layout]:
        """A one-dimensional coordinate array, as the driver needs it for plans."""
        layout = self.layout(key)
        if len(layout.shape) != 1:
            raise ValueError(f"the coordinates {key!r} have {len(layout.shape)} dimensions")
        parts = sorted((r.chunk, layout.decode(None if r.content is None else bytes(r.content))) for r in self.chunks(key, layout).collect())
        return np.concatenate([p for _, p in parts])[: layout.shape[0]], layout


def decoded_times(values: np.ndarray, units: str) -> np.ndarray:
    """Numbers of "days since 1970-01-01" and the like as times."""
    unit, _, since = units.partition(" since ")
    steps = {"days": "D", "hours": "h", "minutes": "m", "seconds": "s", "milliseconds": "ms", "microseconds": "us", "nanoseconds": "ns"}
    if unit not in steps:
        raise ValueError(f"unknown units of time {units!r}")
    start = np.datetime64(since.strip().replace(" ", "T").removesuffix("Z"), "us")
    width = np.timedelta64(1, steps[unit]).astype("timedelta64[ns]").astype(float) / 1000
    return start + np.round(values * width).astype("timedelta64[us]")
