"""Caches as nodes: whole results by plan and request, and partial results on a grid."""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable
from fnmatch import fnmatchcase
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.functions import timeunits as tu
from lodegrid.plans import files
from lodegrid.plans.coordinates import Coordinates
from lodegrid.plans.coverage import Coverage
from lodegrid.plans.node import Node, Request
from lodegrid.plans.settings import settings


def expiry(given: object, now: float | None = None) -> float | None:
    """Seconds since the epoch from a duration ("1,h", seconds, timedelta) or a moment."""
    if given is None:
        return None
    now = time.time() if now is None else now
    if isinstance(given, (int, float)):
        return now + float(given)
    v = tu.value(given) if isinstance(given, str) else given
    import numpy as np

    if isinstance(v, np.datetime64):
        return tu.micros(v) / 1e6
    return now + tu.micros(np.timedelta64(v)) / 1e6


class Store:
    """A manifest of entries in a folder: put, get, has, remove (with "*"), clear, cleanup. With a session the folder may
    lie on any file system that Spark knows (``s3a://`` too), without one on the driver's machine."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        self.root, self.spark = str(root).rstrip("/"), spark

    def _path(self, group: str, key: str) -> str:
        return f"{self.root}/{group}/{key}.json"

    def _write(self, group: str, key: str, text: str) -> None:
        if self.spark is not None:
            files.write_text(self.spark, self._path(group, key), text)
            return
        p = Path(self._path(group, key))
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    def _read(self, group: str, key: str) -> str | None:
        if self.spark is not None:
            return files.read_text(self.spark, self._path(group, key))
        p = Path(self._path(group, key))
        return p.read_text() if p.exists() else None

    def _entries(self) -> list[tuple[str, str]]:
        if self.spark is not None:
            return [(group, name.removesuffix(".json")) for group, name in files.below(self.spark, self.root) if name.endswith(".json")]
        return [(p.parent.name, p.stem) for p in Path(self.root).glob("*/*.json")]

    def _drop(self, group: str, key: str) -> None:
        if self.spark is not None:
            files.delete(self.spark, self._path(group, key))
        else:
            Path(self._path(group, key)).unlink()

    def put(self, group: str, key: str, value: object, expires: object = None) -> None:
        self._write(group, key, json.dumps({"value": value, "expires": expiry(expires)}))

    def get(self, group: str, key: str) -> object:
        if not self.has(group, key):
            raise KeyError((group, key))
        return json.loads(self._read(group, key))["value"]

    def has(self, group: str, key: str) -> bool:
        found = self._read(group, key)
        end = None if found is None else json.loads(found)["expires"]
        return found is not None and (end is None or end > time.time())

    def remove(self, group: str = "*", key: str = "*") -> int:
        found = [(g, k) for g, k in self._entries() if fnmatchcase(g, group) and fnmatchcase(k, key)]
        for g, k in found:
            self._drop(g, k)
        return len(found)

    def clear(self) -> None:
        self.remove()

    def cleanup(self) -> int:
        """Drop what has expired."""
        gone = [(g, k) for g, k in self._entries() if not self.has(g, k)]
        for g, k in gone:
            self._drop(g, k)
        return len(gone)


class MemoryStore(Store):
    """The same in the driver's memory, up to ``limit`` bytes of text: beyond it the oldest entries go."""

    def __init__(self, limit: int = 1_000_000_000):
        self.limit, self.texts, self.size = limit, {}, 0

    def _write(self, group: str, key: str, text: str) -> None:
        self._drop(group, key)
        self.texts[group, key] = text
        self.size += len(text)
        while self.size > self.limit and len(self.texts) > 1:
            self._drop(*next(iter(self.texts)))

    def _read(self, group: str, key: str) -> str | None:
        return self.texts.get((group, key))

    def _entries(self) -> list[tuple[str, str]]:
        return list(self.texts)

    def _drop(self, group: str, key: str) -> None:
        self.size -= len(self.texts.pop((group, key), ""))


class CacheControl:
    """Several stores by mode ("ram", "disk", "s3" ...), in order: an entry is put into all (or one), and found in the first."""

    def __init__(self, stores: dict[str, Store]):
        self.stores = stores

    def _chosen(self, mode: str) -> list[Store]:
        if mode != "all" and mode not in self.stores:
            raise ValueError(f"no store {mode!r} among {sorted(self.stores)}")
        return [s for m, s in self.stores.items() if mode in ("all", m)]

    def put(self, group: str, key: str, value: object, mode: str = "all", expires: object = None) -> None:
        for s in self._chosen(mode):
            s.put(group, key, value, expires)

    def get(self, group: str, key: str, mode: str = "all") -> object:
        for s in self._chosen(mode):
            if s.has(group, key):
                return s.get(group, key)
        raise KeyError((group, key))

    def has(self, group: str, key: str, mode: str = "all") -> bool:
        return any(s.has(group, key) for s in self._chosen(mode))

    def remove(self, group: str = "*", key: str = "*", mode: str = "all") -> int:
        return sum(s.remove(group, key) for s in self._chosen(mode))

    def clear(self, mode: str = "all") -> None:
        self.remove(mode=mode)

    def cleanup(self, mode: str = "all") -> int:
        return sum(s.cleanup() for s in self._chosen(mode))


def cached_property(method: Callable | None = None, *, control: CacheControl | None = None, expires: object = None):
    """A property that is computed once for each node. With ``control`` equal nodes share it, by their hash, and it lives
    as long as the entry (its value must have a JSON form then)."""
    if method is None:
        return functools.partial(cached_property, control=control, expires=expires)

    @functools.wraps(method)
    def get(node: Node) -> object:
        memo = node.__dict__.setdefault("_memo", {})
        if method.__name__ not in memo:
            if control is not None and control.has(node.hash, method.__name__):
                memo[method.__name__] = control.get(node.hash, method.__name__)
            else:
                memo[method.__name__] = method(node)
                if control is not None:
                    control.put(node.hash, method.__name__, memo[method.__name__], expires=expires)
        return memo[method.__name__]

    return property(get)


class HashCache(Node):
    """Whole results as Parquet under <path>/<plan>/<request>; a hit reads the table and runs nothing else. With
    ``expires`` (a duration or a moment, from the time of writing) an entry is made anew once that is past."""

    attributes = {"path": None, "uid": None, "force_eval": False, "expires": None}

    def find_coordinates(self):
        return self.inputs["source"].find_coordinates()

    def place(self, coords: Coordinates) -> str:
        root = self.attrs["path"] or settings["CACHE_PATH"]
        return f"{str(root).rstrip('/')}/{self.attrs['uid'] or self.inputs['source'].hash}/{coords.hash}"

    def build(self, request: Request) -> Coverage:
        source = self.inputs["source"]
        if not settings["ENABLE_CACHE"]:
            return source.compile(request)
        path = self.place(request.coords)
        c = source.compile(request)
        end = files.read_text(request.spark, f"{path}/_expires")
        stale = end is not None and float(end) <= time.time()
        if self.attrs["force_eval"] or stale or not files.exists(request.spark, f"{path}/_SUCCESS"):
            c.df.write.mode("overwrite").parquet(path)
            if self.attrs["expires"] is not None:
                files.write_text(request.spark, f"{path}/_expires", str(expiry(self.attrs["expires"])))
        return c.with_df(request.spark.read.schema(c.df.schema).parquet(path))


class PartialCache(Node):
    """Results cell by cell: what a request lacks in the store is evaluated on the smallest grid that holds
    the missing cells, appended, and everything is read back."""

    attributes = {"path": None, "uid": None}

    def find_coordinates(self):
        return self.inputs["source"].find_coordinates()

    def place(self) -> str:
        root = self.attrs["path"] or settings["CACHE_PATH"]
        return f"{str(root).rstrip('/')}/partial/{self.attrs['uid'] or self.inputs['source'].hash}"

    def missing(self, request: Request) -> DataFrame:
        """Requested cells without an entry (an anti-join)."""
        wanted = request.frame().select(*request.coords.udims)
        if not files.exists(request.spark, self.place()):
            return wanted
        return wanted.join(request.spark.read.parquet(self.place()).select(*request.coords.udims), list(request.coords.udims), "left_anti")

    def build(self, request: Request) -> Coverage:
        source, dims = self.inputs["source"], list(request.coords.udims)
        lacking = self.missing(request)
        ends = lacking.agg(*(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).head()
        if ends[0] is not None:
            box = request.coords.select({d: [ends[f"lo_{d}"], ends[f"hi_{d}"]] for d in dims})
            c = source.compile(request.at(box))
            c.df.join(lacking, dims, "left_semi").write.mode("append").parquet(self.place())
        stored = request.spark.read.parquet(self.place())
        outputs = [x for x in stored.columns if x not in dims]
        return Coverage(request.frame().select(*dims).join(stored, dims, "left"), tuple(dims), tuple(outputs))
