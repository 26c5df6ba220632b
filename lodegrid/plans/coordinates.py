"""Coordinates: what a request asks for and where a source has values.

A grid is a product of one-dimensional axes; a stack zips axes into points. Axes live on the driver as
a rule (start, step, size) or a list; grids never do: ``Coordinates.frame`` builds them from
``spark.range`` and expressions, with an integer index for every axis so that joins never compare
floating-point values.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator
from urllib.parse import parse_qs, urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.functions import crs as crs_
from lodegrid.functions import timeunits as tu

DIMENSIONS = ["lat", "lon", "alt", "time"]


def add_valid_dimension(name: str) -> None:
    """Allow one more dimension; "-" and "_" separate names and so cannot stand in one."""
    if name in DIMENSIONS:
        raise ValueError(f"dimension {name!r} already exists")
    if "-" in name or "_" in name or not name:
        raise ValueError(f"invalid dimension name {name!r}")
    DIMENSIONS.append(name)


def index_column(dim: str) -> str:
    """The integer position along an axis, carried beside its values."""
    return f"__i_{dim}"


def literal(v: float | np.datetime64) -> Column:
    if isinstance(v, np.datetime64):
        return F.timestamp_micros(F.lit(tu.micros(v)))
    return F.lit(float(v))


class Axis:
    """One dimension's values, in order. ``UniformAxis`` knows its rule; this class holds a list."""

    uniform = False

    def __init__(self, values: object, name: str | None = None):
        items = list(values) if isinstance(values, (list, tuple, np.ndarray, range)) else [values]
        items = [tu.value(v) for v in items]
        kinds = {np.datetime64 if isinstance(v, np.datetime64) else np.timedelta64 if isinstance(v, np.timedelta64) else float for v in items}
        if len(kinds) > 1:
            raise ValueError("coordinates must be all numbers or all times")
        if kinds == {np.datetime64}:
            unit = max((tu.unit(v) for v in items), key=tu.UNITS.index)
            self.values = np.array([v.astype(f"datetime64[{unit}]") for v in items])
        else:
            self.values = np.array(items, dtype=float if kinds != {np.timedelta64} else None)
        self.name = name

    # -- properties ---------------------------------------------------------------------------
    @property
    def coordinates(self) -> np.ndarray:
        return self.values

    @property
    def size(self) -> int:
        return len(self.values)

    @property
    def is_time(self) -> bool:
        return self.values.dtype.kind == "M"

    @property
    def monotonic(self) -> bool:
        d = np.diff(self.values)
        zero = d.dtype.type(0)
        return self.size <= 1 or bool((d > zero).all() or (d < zero).all())

    @property
    def descending(self) -> bool:
        return self.size > 1 and self.monotonic and bool(self.values[0] > self.values[-1])

    @property
    def bounds(self) -> list:
        return [self.values.min(), self.values.max()] if self.size else [np.nan, np.nan]

    def area_bounds(self, boundary: object = None) -> list:
        """Bounds widened by a boundary, a half width for all cells."""
        lo, hi = self.bounds
        if boundary is None:
            return [lo, hi]
        b = tu.step(boundary)
        if self.is_time:
            return [tu.add(lo, -b), tu.add(hi, b)]
        return [lo - b, hi + b]

    def __len__(self) -> int:
        return self.size

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Axis) and self.name == other.name and self.size == other.size and bool(np.array_equal(self.coordinates, other.coordinates))

    def __contains__(self, v: object) -> bool:
        return bool((self.coordinates == tu.value(v)).any())

    def __getitem__(self, at: object) -> Axis:
        return Axis(np.atleast_1d(self.coordinates[at]), self.name)

    def renamed(self, name: str) -> Axis:
        out = self.__class__.__new__(self.__class__)
        out.__dict__.update(self.__dict__)
        out.name = name
        return out

    # -- selection ----------------------------------------------------------------------------
    def select(self, bounds: object, outer: bool = False, return_index: bool = False):
        """The part within bounds (a pair, or a dict by dimension). ``outer`` keeps one more point on
        each side unless a bound is exactly on a point. Bounds that fall between two points of a
        monotonic axis select the points nearest to them."""
        if isinstance(bounds, dict):
            bounds = bounds.get(self.name)
        index = np.arange(self.size) if bounds is None or not self.size else self._index([tu.value(b) for b in bounds], outer)
        out = self._part(index)
        return (out, index) if return_index else out

    def _part(self, index: np.ndarray) -> Axis:
        return Axis(self.coordinates[index], self.name)

    def _index(self, bounds: list, outer: bool) -> np.ndarray:
        mine = self.bounds
        if self.is_time != isinstance(bounds[0], np.datetime64):
            raise TypeError(f"bounds {bounds} do not fit the type of axis {self.name}")
        none = np.empty(0, int)
        if self.is_time:
            mine, bounds = tu.coarser_bounds(mine, bounds, outer)
        if bounds[0] > bounds[1] or bounds[0] > mine[1] or bounds[1] < mine[0]:
            return none
        if mine[0] >= bounds[0] and mine[1] <= bounds[1]:
            return np.arange(self.size)
        if self.is_time:
            bounds = tu.widened(bounds, tu.unit(self.coordinates[:1]), outer)
        return self._within(bounds, outer)

    def _within(self, bounds: list, outer: bool) -> np.ndarray:
        x, (lo, hi) = self.coordinates, bounds
        if outer:
            below, above = x[x <= lo], x[x >= hi]
            keep = (x >= (below.max() if len(below) else lo)) & (x <= (above.min() if len(above) else hi))
            return np.flatnonzero(keep)
        inside = np.flatnonzero((x >= lo) & (x <= hi))
        if len(inside) or not self.monotonic:
            return inside
        at = [int(np.abs(x - b).argmin()) for b in (lo, hi)]
        return np.arange(min(at), max(at) + 1)

    # -- sets ---------------------------------------------------------------------------------
    def unique(self) -> Axis:
        return Axis(np.unique(self.coordinates), self.name)

    def issubset(self, other: Axis) -> bool:
        return bool(np.isin(self.coordinates.astype(other.coordinates.dtype) if self.is_time else self.coordinates, other.coordinates).all())

    def simplify(self) -> Axis:
        """A uniform axis if the steps are equal (numpy's closeness), else this one."""
        if self.size < 2:
            return self
        d = np.diff(self.values)
        even = bool((d == d[0]).all()) if self.is_time else bool(np.allclose(d, d[0]))
        if not even or d[0] == d.dtype.type(0):
            return self
        return UniformAxis(self.values[0], self.values[-1], size=self.size, name=self.name) if not self.is_time else UniformAxis(self.values[0], self.values[-1], step=d[0], name=self.name)

    # -- Spark --------------------------------------------------------------------------------
    def frame(self, spark: SparkSession) -> DataFrame:
        """(index, value): a literal array, for axes of a request; large sources are tables instead."""
        kind = T.LongType() if self.is_time else T.DoubleType()
        items = [tu.micros(v) if self.is_time else float(v) for v in self.coordinates]
        exploded = F.posexplode(F.lit(items) if items else F.array().cast(T.ArrayType(kind)))
        df = spark.range(1).select(exploded.alias("i", "v"))
        v = F.timestamp_micros("v") if self.is_time else F.col("v").cast("double")
        return df.select(F.col("i").cast("long").alias(index_column(self.name)), v.alias(self.name))

    def definition(self) -> dict:
        return {"name": self.name, "values": [str(v) if self.is_time else float(v) for v in self.coordinates]}


class UniformAxis(Axis):
    """start, stop and either a step or a size. With a step the last value is the last one not beyond
    ``stop``; ``anchor`` says which end is exact. Steps of months and years follow the calendar."""

    uniform = True

    def __init__(self, start: object, stop: object, step: object = None, size: int | None = None, name: str | None = None, anchor: str = "start"):
        if (step is None) == (size is None):
            raise ValueError("give either a step or a size")
        self.name, self.anchor = name, anchor
        start, stop = tu.value(start), tu.value(stop)
        if isinstance(start, np.datetime64) != isinstance(stop, np.datetime64):
            raise ValueError("start and stop must be of one type")
        if size is not None:
            if size < 1:
                raise ValueError("size must be positive")
            if isinstance(start, np.datetime64):
                start, stop = start.astype("datetime64[us]"), stop.astype("datetime64[us]")
                self.step = (stop - start) / max(1, size - 1)
            else:
                self.step = (stop - start) / (size - 1) if size > 1 else (stop - start or 1.0)
            self.count = int(size)
        else:
            self.step = tu.step(step)
            if isinstance(start, np.datetime64) != isinstance(self.step, np.timedelta64):
                raise ValueError("the step does not fit start and stop")
            if isinstance(start, np.datetime64):
                unit = max(tu.unit(start), tu.unit(stop), *([] if tu.nominal(self.step) else [tu.unit(self.step)]), key=tu.UNITS.index)
                start, stop = start.astype(f"datetime64[{unit}]"), stop.astype(f"datetime64[{unit}]")
            self.count = self._count(start, stop)
        self.start, self.stop = start, stop

    def _count(self, start, stop) -> int:
        if isinstance(self.step, np.timedelta64):
            n = int(self.step.astype(np.int64))
            if n == 0 or (stop != start and (n > 0) != bool(stop > start)):
                raise ValueError("the step must lead from start to stop")
            if tu.nominal(self.step):
                n = 0
                while (tu.add(start, self.step, n + 1) <= stop) if stop >= start else (tu.add(start, self.step, n + 1) >= stop):
                    n += 1
                return n + 1
            return int(math.floor((stop - start) / self.step + 1e-10)) + 1
        if self.step == 0 or (stop != start and (self.step > 0) != (stop > start)):
            raise ValueError("the step must lead from start to stop")
        return int(math.floor((stop - start) / self.step + 1e-10)) + 1

    @classmethod
    def from_tuple(cls, items: tuple, name: str | None = None) -> UniformAxis:
        """(start, stop, n): a whole number n is a size, anything else a step."""
        start, stop, third = items
        by_size = isinstance(third, (int, np.integer)) and not isinstance(third, bool)
        return cls(start, stop, size=int(third), name=name) if by_size else cls(start, stop, step=third, name=name)

    @property
    def values(self) -> np.ndarray:
        if isinstance(self.step, np.timedelta64) and tu.nominal(self.step):
            return np.array([tu.add(self.start, self.step, i) for i in range(self.count)])
        if isinstance(self.start, np.datetime64):
            return self.start + self.step * np.arange(self.count)
        origin = self.stop - (self.count - 1) * self.step if self.anchor == "stop" else self.start
        return origin + np.arange(self.count) * self.step

    @property
    def size(self) -> int:
        return self.count

    @property
    def is_time(self) -> bool:
        return isinstance(self.start, np.datetime64)

    @property
    def monotonic(self) -> bool:
        return True

    @property
    def descending(self) -> bool:
        return self.count > 1 and bool(self.step < type(self.step)(0)) if not isinstance(self.step, np.timedelta64) else int(self.step.astype(int)) < 0

    @property
    def bounds(self) -> list:
        v = self.values[[0, -1]]
        return [v.min(), v.max()]

    def _within(self, bounds: list, outer: bool) -> np.ndarray:
        if isinstance(self.step, np.timedelta64) and tu.nominal(self.step):
            return super()._within(bounds, outer)
        low, size = self.bounds[0], self.count
        width = abs(self.step) if not self.is_time else abs(tu.micros(self.step))
        place = (lambda b: (tu.micros(b) - tu.micros(low)) / width) if self.is_time else (lambda b: (b - low) / width)
        first, last = place(bounds[0]), place(bounds[1])
        if outer:
            i, j = math.floor(first), math.ceil(last)
        else:
            i, j = max(0, math.ceil(first)), min(size - 1, math.floor(last))
            if i > j:  # between two points: each bound takes its nearest point, half-way ones the even index
                i, j = round(first), round(last)
        i, j = max(0, i), min(size - 1, j)
        index = np.arange(i, j + 1)
        return (size - 1 - index)[::-1] if self.descending else index

    def _part(self, index: np.ndarray) -> Axis:
        if not len(index):
            return Axis([], self.name)
        if len(index) == 1 or (isinstance(self.step, np.timedelta64) and tu.nominal(self.step)):
            return Axis(self.values[index], self.name)
        v = self.values[[index[0], index[-1]]]
        return UniformAxis(v[0], v[1], step=self.step, name=self.name) if self.is_time else UniformAxis(v[0], v[1], size=len(index), name=self.name)

    def issubset(self, other: Axis) -> bool:
        if isinstance(other, UniformAxis) and not self.is_time and not other.is_time:
            ratio, offset = self.step / other.step, (self.start - other.start) / other.step
            on_grid = abs(ratio - round(ratio)) < 1e-9 and abs(offset - round(offset)) < 1e-9
            lo, hi = other.bounds
            return (on_grid or self.count == 1 and abs(offset - round(offset)) < 1e-9) and self.bounds[0] >= lo - 1e-9 and self.bounds[1] <= hi + 1e-9
        return super().issubset(other)

    def simplify(self) -> Axis:
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        """(index, value) from ``spark.range``: no list, whatever the size."""
        i = F.col("id")
        if not self.is_time:
            v = F.lit(float(self.values[0])) + i * F.lit(float(self.step))
        elif tu.nominal(self.step):
            months = int(self.step.astype(np.int64)) * (12 if tu.unit(self.step) == "Y" else 1)
            start = literal(self.start)
            v = F.timestamp_micros(F.lit(tu.micros(self.start))) + F.make_interval(F.lit(0), (i * months).cast("int"))
            v = v if start is not None else v
        else:
            v = F.timestamp_micros(F.lit(tu.micros(self.start)) + i * F.lit(tu.micros(self.step)))
        return spark.range(self.count).select(i.alias(index_column(self.name)), v.alias(self.name))

    def definition(self) -> dict:
        text = lambda v: str(v) if self.is_time else float(v)
        size = {"size": self.count} if not self.is_time else {"step": tu.step_text(self.step)}
        return {"name": self.name, "start": text(self.start), "stop": text(self.values[-1] if not self.is_time else self.stop), **size}


class Stack:
    """Points: axes of equal length, zipped."""

    def __init__(self, axes: list[Axis]):
        if len({a.name for a in axes}) != len(axes):
            raise ValueError("duplicate dimension in a stack")
        if len({a.size for a in axes}) > 1:
            raise ValueError("stacked axes must have one length")
        self.axes = axes

    @property
    def name(self) -> str:
        return "_".join(a.name for a in self.axes)

    @property
    def dims(self) -> list[str]:
        return [a.name for a in self.axes]

    @property
    def size(self) -> int:
        return self.axes[0].size

    def __getitem__(self, at: object) -> Stack:
        return Stack([a[at] for a in self.axes])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Stack) and self.axes == other.axes

    def select(self, bounds: dict, outer: bool = False, return_index: bool = False):
        keep = np.arange(self.size)
        for a in self.axes:
            keep = np.intersect1d(keep, a.select(bounds, outer, True)[1])
        out = self[keep]
        return (out, keep) if return_index else out

    def points(self) -> list[tuple]:
        return list(zip(*(a.coordinates.tolist() for a in self.axes), strict=True))

    def unique(self) -> Stack:
        seen: dict[tuple, int] = {}
        for i, p in enumerate(self.points()):
            seen.setdefault(p, i)
        return self[np.array([seen[p] for p in sorted(seen)], int)]

    def issubset(self, other: Stack | dict[str, Axis]) -> bool:
        if isinstance(other, Stack):
            order = [other.dims.index(d) for d in self.dims]
            have = {tuple(p[i] for i in order) for p in other.points()}
            return all(p in have for p in self.points())
        return all(a.issubset(other[a.name]) for a in self.axes)

    def simplify(self) -> Stack:
        return Stack([a.simplify() for a in self.axes])

    def frame(self, spark: SparkSession) -> DataFrame:
        """(point index, and each dimension)."""
        kinds = [T.LongType() if a.is_time else T.DoubleType() for a in self.axes]
        rows = [[tu.micros(v) if a.is_time else float(v) for v in a.coordinates] for a in self.axes]
        zipped = F.arrays_zip(*(F.lit(r) if r else F.array().cast(T.ArrayType(k)) for r, k in zip(rows, kinds, strict=True)))
        df = spark.range(1).select(F.posexplode(zipped).alias("i", "x"))
        names = df.schema["x"].dataType.names
        cols = [(F.timestamp_micros(F.col("x")[n]) if a.is_time else F.col("x")[n].cast("double")).alias(a.name) for a, n in zip(self.axes, names, strict=True)]
        return df.select(F.col("i").cast("long").alias(index_column(self.name)), *cols)

    def definition(self) -> list[dict]:
        return [a.definition() for a in self.axes]


class AffineGrid:
    """Pixel centres of a raster: a GDAL geotransform (x0, xx, xy, y0, yx, yy) and a shape (rows, columns)."""

    name, dims = "lat_lon", ["lat", "lon"]

    def __init__(self, geotransform: tuple[float, ...], shape: tuple[int, int]):
        self.geotransform, self.shape = tuple(float(g) for g in geotransform), tuple(shape)

    @property
    def size(self) -> int:
        return self.shape[0] * self.shape[1]

    def at(self, i, j) -> tuple:
        x0, xx, xy, y0, yx, yy = self.geotransform
        return y0 + (j + 0.5) * yx + (i + 0.5) * yy, x0 + (j + 0.5) * xx + (i + 0.5) * xy

    def select(self, bounds: dict, outer: bool = False):
        """Inner: the points inside, as a stack. Outer: the smallest window of rows and columns around them, one cell wider."""
        i, j = np.meshgrid(np.arange(self.shape[0]), np.arange(self.shape[1]), indexing="ij")
        lat, lon = self.at(i, j)
        keep = np.ones(self.shape, bool)
        for d, v in (("lat", lat), ("lon", lon)):
            if d in bounds:
                keep &= (v >= bounds[d][0]) & (v <= bounds[d][1])
        rows, cols = np.nonzero(keep)
        if not outer:
            return Stack([Axis(lat[keep], "lat"), Axis(lon[keep], "lon")])
        if not len(rows):
            return AffineGrid(self.geotransform, (0, 0))
        a, b = max(0, rows.min() - 1), min(self.shape[0], rows.max() + 2)
        c, d = max(0, cols.min() - 1), min(self.shape[1], cols.max() + 2)
        x0, xx, xy, y0, yx, yy = self.geotransform
        return AffineGrid((x0 + c * xx + a * xy, xx, xy, y0 + c * yx + a * yy, yx, yy), (int(b - a), int(d - c)))

    def simplify(self) -> list[Axis] | AffineGrid:
        """Two uniform axes if the raster is not rotated."""
        _, xx, xy, _, yx, yy = self.geotransform
        if xy or yx or min(self.shape) < 1:
            return self
        (lat0, lon0), (lat1, lon1) = self.at(0, 0), self.at(self.shape[0] - 1, self.shape[1] - 1)
        return [UniformAxis(lat0, lat1, size=self.shape[0], name="lat"), UniformAxis(lon0, lon1, size=self.shape[1], name="lon")]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = spark.range(self.shape[0]).select(F.col("id").alias("r"))
        cells = rows.crossJoin(spark.range(self.shape[1]).select(F.col("id").alias("c")))
        lat, lon = self.at(F.col("r"), F.col("c"))
        return cells.select((F.col("r") * self.shape[1] + F.col("c")).alias(index_column("lat_lon")), lat.alias("lat"), lon.alias("lon"))

    def definition(self) -> dict:
        return {"geotransform": list(self.geotransform), "shape": list(self.shape)}


class PolarGrid:
    """Points around a centre (lat, lon): radii (positive) and angles from the lon axis, in radians."""

    name, dims = "lat_lon", ["lat", "lon"]

    def __init__(self, center: tuple[float, float], radius: list[float], theta: list[float] | None = None, theta_size: int | None = None):
        if min(radius, default=1) <= 0:
            raise ValueError("radii must be positive")
        if (theta is None) == (theta_size is None):
            raise ValueError("give either theta or theta_size")
        self.center, self.radius = center, [float(r) for r in radius]
        self.theta = [float(t) for t in theta] if theta is not None else np.linspace(0, 2 * math.pi, theta_size + 1)[:-1].tolist()

    @property
    def size(self) -> int:
        return len(self.radius) * len(self.theta)

    def stack(self) -> Stack:
        pairs = [(self.center[0] + r * math.sin(t), self.center[1] + r * math.cos(t)) for r in self.radius for t in self.theta]
        return Stack([Axis([p[0] for p in pairs], "lat"), Axis([p[1] for p in pairs], "lon")])

    def select(self, bounds: dict, outer: bool = False):
        return self.stack().select(bounds, outer)

    def frame(self, spark: SparkSession) -> DataFrame:
        r = Axis(self.radius, "r").frame(spark)
        grid = r.crossJoin(Axis(self.theta, "t").frame(spark))
        i = F.col(index_column("r")) * len(self.theta) + F.col(index_column("t"))
        return grid.select(i.alias(index_column("lat_lon")), (self.center[0] + F.col("r") * F.sin("t")).alias("lat"), (self.center[1] + F.col("r") * F.cos("t")).alias("lon"))

    def definition(self) -> dict:
        return {"center": list(self.center), "radius": self.radius, "theta": self.theta}


Part = Axis | Stack | AffineGrid | PolarGrid


class Coordinates:
    """An ordered set of axes and stacks, and a CRS."""

    def __init__(self, parts: list, dims: list[str] | None = None, crs: str = crs_.DEFAULT):
        dims = dims or [None] * len(parts)
        if len(dims) != len(parts):
            raise ValueError("dims and coordinates differ in number")
        made: list[Part] = []
        for part, dim in zip(parts, dims, strict=True):
            if isinstance(part, (Stack, AffineGrid, PolarGrid)):
                made.append(part)
            elif isinstance(part, Axis):
                made.append(part if dim is None else part.renamed(dim))
            elif dim and "_" in dim:
                made.append(Stack([a if isinstance(a, Axis) else _axis(a, d) for a, d in zip(part, dim.split("_"), strict=True)]) if not isinstance(part, Axis) else part)
                made[-1] = Stack([a.renamed(d) for a, d in zip(made[-1].axes, dim.split("_"), strict=True)])
            else:
                made.append(_axis(part, dim))
        self.parts, self.crs = made, crs
        if len(set(self.udims)) != len(self.udims):
            raise ValueError("each dimension may appear once")
        for d in self.udims:
            if d not in DIMENSIONS:
                raise ValueError(f"invalid dimension {d!r}; known are {DIMENSIONS}")
        if "alt" in self.udims and crs_.vertical_unit(crs) is None:
            raise ValueError("alt needs a CRS with vertical units")

    # -- constructors -------------------------------------------------------------------------
    @classmethod
    def grid(cls, dims: list[str] | None = None, crs: str = crs_.DEFAULT, **axes: object) -> Coordinates:
        """Keyword axes: tuples are uniform (start, stop, size or step), lists are values, "lat_lon" stacks pairs."""
        order = dims or list(axes)
        return cls([_part(axes[d], d) for d in order], crs=crs)

    @classmethod
    def points(cls, dims: list[str] | None = None, crs: str = crs_.DEFAULT, **axes: object) -> Coordinates:
        """One stack of the keyword axes."""
        order = dims or list(axes)
        return cls([Stack([_axis(axes[d], d) for d in order])], crs=crs)

    @classmethod
    def from_definition(cls, definition: dict) -> Coordinates:
        def axis(d: dict) -> Axis:
            if "values" in d:
                return Axis(d["values"], d["name"])
            return UniformAxis(d["start"], d["stop"], step=d.get("step"), size=d.get("size"), name=d["name"])

        parts: list[Part] = []
        for d in definition["coords"]:
            if isinstance(d, list):
                parts.append(Stack([axis(a) for a in d]))
            elif "geotransform" in d:
                parts.append(AffineGrid(d["geotransform"], d["shape"]))
            elif "radius" in d:
                parts.append(PolarGrid(d["center"], d["radius"], d["theta"]))
            else:
                parts.append(axis(d))
        return cls(parts, crs=definition.get("crs", crs_.DEFAULT))

    @classmethod
    def from_json(cls, text: str) -> Coordinates:
        return cls.from_definition(json.loads(text))

    @classmethod
    def from_geotransform(cls, geotransform: tuple[float, ...], shape: tuple[int, int], crs: str = crs_.DEFAULT) -> Coordinates:
        made = AffineGrid(geotransform, shape).simplify()
        return cls(made if isinstance(made, list) else [made], crs=crs)

    @classmethod
    def from_url(cls, url: str) -> Coordinates:
        """The grid of a WMS or WCS request. BBOX gives pixel edges, so centres lie half a pixel inside;
        geographic CRSs of WMS 1.3 and WCS 1.1+ put latitude first."""
        q = {k.upper(): v[0] for k, v in parse_qs(urlparse(url).query).items()}
        crs = q.get("CRS") or q.get("SRS") or "EPSG:4326"
        a, b, c, d = (float(x) for x in q["BBOX"].split(",")[:4])
        version = tuple(int(x) for x in re.findall(r"\d+", q.get("VERSION", "1.1.1"))[:2])
        lat_first = crs.upper() == "EPSG:4326" and ((q.get("SERVICE", "WMS").upper() == "WMS" and version >= (1, 3)) or (q.get("SERVICE", "").upper() == "WCS" and version >= (1, 1)))
        south, west, north, east = (a, b, c, d) if lat_first else (b, a, d, c)
        rows, cols = int(q["HEIGHT"]), int(q["WIDTH"])
        dy, dx = (north - south) / rows, (east - west) / cols
        axes: list[Part] = [UniformAxis(north - dy / 2, south + dy / 2, size=rows, name="lat"), UniformAxis(west + dx / 2, east - dx / 2, size=cols, name="lon")]
        if q.get("TIME"):
            axes.insert(0, Axis([q["TIME"]], "time"))
        return cls(axes, crs=crs if crs_.kind(crs) != "longlat" else crs_.DEFAULT)

    @classmethod
    def from_frame(cls, df: DataFrame, dims: list[str], crs: str = crs_.DEFAULT) -> Coordinates:
        """The distinct values of small dimension columns as a grid of lists (one row of the driver a value)."""
        axes = []
        for d in dims:
            items = [r[0] for r in df.select(d).where(F.col(d).isNotNull()).distinct().orderBy(d).collect()]
            axes.append(Axis([np.datetime64(v) if hasattr(v, "year") else v for v in items], d))
        return cls(axes, crs=crs)

    # -- properties ---------------------------------------------------------------------------
    @property
    def dims(self) -> list[str]:
        return [p.name for p in self.parts]

    @property
    def udims(self) -> list[str]:
        return [d for p in self.parts for d in ([p.name] if isinstance(p, Axis) else p.dims)]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(n for p in self.parts for n in (p.shape if isinstance(p, AffineGrid) else (p.size,)))

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(p.size for p in self.parts) if self.parts else 0

    def axis(self, dim: str) -> Axis:
        for p in self.parts:
            if isinstance(p, Axis) and p.name == dim:
                return p
            if isinstance(p, (Stack, PolarGrid)):
                for a in (p if isinstance(p, Stack) else p.stack()).axes:
                    if a.name == dim:
                        return a
        raise KeyError(dim)

    def __getitem__(self, key: object):
        """A dimension by name, or a slice of each axis by position."""
        if isinstance(key, str):
            return next((p for p in self.parts if p.name == key), None) or self.axis(key)
        keys = key if isinstance(key, tuple) else (key,)
        keys += (slice(None),) * (len(self.parts) - len(keys))
        return Coordinates([p[k] for p, k in zip(self.parts, keys, strict=True)], crs=self.crs)

    @property
    def bounds(self) -> dict[str, list]:
        return {d: self.axis(d).bounds for d in self.udims if self._has_axis(d)}

    def _has_axis(self, d: str) -> bool:
        return not any(isinstance(p, AffineGrid) and d in p.dims for p in self.parts)

    def area_bounds(self, boundary: dict[str, object]) -> dict[str, list]:
        return {d: self.axis(d).area_bounds(boundary.get(d)) for d in self.udims}

    @property
    def geotransform(self) -> tuple[float, ...]:
        """The GDAL 6-tuple of a uniform lat/lon grid: corner of the first pixel and steps."""
        for p in self.parts:
            if isinstance(p, AffineGrid):
                return p.geotransform
        lat, lon = self.axis("lat").simplify(), self.axis("lon").simplify()
        if not (lat.uniform and lon.uniform):
            raise TypeError("only uniform lat and lon axes have a geotransform")
        return (lon.values[0] - lon.step / 2, lon.step, 0.0, lat.values[0] - lat.step / 2, 0.0, lat.step)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Coordinates) and self.dims == other.dims and crs_.same(self.crs, other.crs) and self.parts == other.parts

    def __contains__(self, point: tuple) -> bool:
        left = list(point)
        for p in self.parts:
            if isinstance(p, Axis):
                if tu.value(left.pop(0)) not in p.coordinates:
                    return False
            else:
                n = len(p.dims)
                item, left = tuple(tu.value(v) for v in left[:n]), left[n:]
                if item not in p.points():
                    return False
        return True

    def definition(self) -> dict:
        return {"coords": [p.definition() for p in self.parts], "crs": self.crs}

    @property
    def json(self) -> str:
        return json.dumps(self.definition(), separators=(",", ":"))

    @property
    def hash(self) -> str:
        """Identity of the request, whatever the order and form of its axes."""
        parts = sorted((p.simplify() if isinstance(p, Axis) else p for p in self.parts), key=lambda p: p.name)
        text = json.dumps([p.definition() for p in parts] + [crs_.kind(self.crs)], separators=(",", ":"))
        return hashlib.md5(text.encode()).hexdigest()

    # -- algebra ------------------------------------------------------------------------------
    def select(self, bounds: dict, outer: bool = False) -> Coordinates:
        return Coordinates([p.select(bounds, outer) for p in self.parts], crs=self.crs)

    def intersect(self, other: Coordinates, dims: list[str] | None = None, outer: bool = False) -> Coordinates:
        """The part within the other's bounds (a box, not a set of keys), in this CRS."""
        other = other.transform(self.crs) if not crs_.same(self.crs, other.crs) else other
        return self.select({d: b for d, b in other.bounds.items() if dims is None or d in dims}, outer)

    def issubset(self, other: Coordinates) -> bool:
        if set(self.udims) != set(other.udims):
            return False
        for p in self.parts:
            if isinstance(p, Axis):
                if not p.issubset(other.axis(p.name)):
                    return False
            else:
                match = next((q for q in other.parts if isinstance(q, Stack) and set(q.dims) == set(p.dims)), None)
                if not p.issubset(match or {d: other.axis(d) for d in p.dims}):
                    return False
        return True

    def unique(self) -> Coordinates:
        return Coordinates([p.unique() for p in self.parts], crs=self.crs)

    def drop(self, dims: str | list[str]) -> Coordinates:
        names = [dims] if isinstance(dims, str) else dims
        if missing := [d for d in names if d not in self.dims]:
            raise KeyError(f"no dimension {missing}")
        return Coordinates([p for p in self.parts if p.name not in names], crs=self.crs)

    def udrop(self, dims: str | list[str]) -> Coordinates:
        """Drop single dimensions, also out of stacks."""
        names = [dims] if isinstance(dims, str) else dims
        if missing := [d for d in names if d not in self.udims]:
            raise KeyError(f"no dimension {missing}")
        parts: list[Part] = []
        for p in self.parts:
            axes = [p] if isinstance(p, Axis) else [a for a in p.axes]
            left = [a for a in axes if a.name not in names]
            if left:
                parts.append(left[0] if len(left) == 1 else Stack(left))
        return Coordinates(parts, crs=self.crs)

    def transpose(self, *dims: str) -> Coordinates:
        order = list(dims) or self.dims[::-1]
        parts = []
        for d in order:
            p = next((p for p in self.parts if p.name == d or (not isinstance(p, Axis) and sorted(p.dims) == sorted(d.split("_")))), None)
            if p is None:
                raise ValueError(f"invalid transpose {order} of {self.dims}")
            parts.append(p if p.name == d else Stack([self.axis(u) for u in d.split("_")]))
        if len(parts) != len(self.parts):
            raise ValueError(f"invalid transpose {order} of {self.dims}")
        return Coordinates(parts, crs=self.crs)

    def unstack(self) -> Coordinates:
        """The members of stacks as axes of a product."""
        return Coordinates([a for p in self.parts for a in ([p] if isinstance(p, Axis) else p.axes)], crs=self.crs)

    def simplify(self) -> Coordinates:
        made: list[Part] = []
        for p in self.parts:
            s = p.simplify() if not isinstance(p, PolarGrid) else p
            made += s if isinstance(s, list) else [s]
        return Coordinates(made, crs=self.crs)

    def iterchunks(self, shape: tuple[int, ...]) -> Iterator[Coordinates]:
        """Requests of at most ``shape``, in order."""
        ranges = [[slice(i, min(i + n, p.size)) for i in range(0, p.size, n)] for p, n in zip(self.parts, shape, strict=True)]
        for slices in itertools.product(*ranges):
            yield self[slices]

    def transform_time(self, unit: str) -> Coordinates:
        from lodegrid.functions.calendar import parts_of

        t = self.axis("time")
        return Coordinates([Axis([parts_of(v, unit) for v in t.coordinates], "time") if p.name == "time" else p for p in self.parts], crs=self.crs)

    def transform(self, crs: str) -> Coordinates:
        """In another CRS. Longitude/latitude and Web Mercator are separable, so axes stay axes; they stay
        uniform only where the rule is linear (longitude)."""
        if crs_.same(crs, self.crs):
            return Coordinates(self.parts, crs=crs)
        if crs_.kind(crs) != crs_.kind(self.crs) and not {"lat", "lon"} <= set(self.udims):
            raise ValueError("a horizontal transform needs lat and lon")
        factor = crs_.vertical_factor(self.crs, crs)

        def moved(a: Axis) -> Axis:
            if a.name == "lat":
                new = [crs_.transform_value(float(v), 0.0, self.crs, crs)[0] for v in a.coordinates]
            elif a.name == "lon":
                new = [crs_.transform_value(0.0, float(v), self.crs, crs)[1] for v in a.coordinates]
            elif a.name == "alt":
                new = [float(v) * factor for v in a.coordinates]
            else:
                return a
            out = Axis(new, a.name)
            return out.simplify() if a.uniform else out

        parts = [moved(p) if isinstance(p, Axis) else Stack([moved(a) for a in (p if isinstance(p, Stack) else p.stack()).axes]) for p in self.parts]
        return Coordinates(parts, crs=crs)

    def horizontal_resolution(self, units: str = "m", restype: str = "nominal") -> dict[str, float | list[float]]:
        """Spacing of lat and lon: ``nominal`` is extent over steps (lon at the middle latitude), ``summary``
        the mean and deviation of neighbours' distances, ``full`` all of them. A stack gives the mean
        distance to each point's nearest neighbour."""
        out: dict = {}
        for p in self.parts:
            if isinstance(p, Stack) and {"lat", "lon"} <= set(p.dims):
                lat, lon = self.axis("lat").coordinates, self.axis("lon").coordinates
                near = [min(crs_.distance((a, b), (c, d), self.crs, units) for k, (c, d) in enumerate(zip(lat, lon, strict=True)) if k != i) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
                out[p.name] = float(np.mean(near)) if restype == "nominal" else (float(np.mean(near)), float(np.std(near))) if restype == "summary" else near
            elif isinstance(p, Axis) and p.name in ("lat", "lon") and p.size > 1:
                middle = float(np.median(self.axis("lat").coordinates)) if "lat" in self.udims else 0.0
                pair = (lambda a, b: crs_.distance((a, 0.0), (b, 0.0), self.crs, units)) if p.name == "lat" else (lambda a, b, m=middle: crs_.distance((m, a), (m, b), self.crs, units))
                if restype == "nominal":
                    out[p.name] = pair(*map(float, p.bounds)) / (p.size - 1)
                else:
                    each = [pair(float(a), float(b)) for a, b in zip(p.coordinates, p.coordinates[1:], strict=False)]
                    out[p.name] = each if restype == "full" else (float(np.mean(each)), float(np.std(each)))
        return out

    # -- Spark --------------------------------------------------------------------------------
    def frame(self, spark: SparkSession, index: bool = True) -> DataFrame:
        """The request as a table: a row for each cell, with the axes' positions. A grid is the product of
        its axes by construction, so this is the one place that multiplies tables."""
        if not self.parts:
            raise ValueError("no dimensions")
        df = self.parts[0].frame(spark)
        for p in self.parts[1:]:
            df = df.crossJoin(F.broadcast(p.frame(spark)) if p.size <= 100_000 else p.frame(spark))
        return df if index else df.select(*self.udims)

    def __repr__(self) -> str:
        return f"Coordinates({', '.join(f'{p.name}[{p.size}]' for p in self.parts)})"


def _axis(items: object, name: str | None) -> Axis:
    if isinstance(items, Axis):
        return items.renamed(name) if name else items
    return UniformAxis.from_tuple(items, name) if isinstance(items, tuple) else Axis(items, name)


def _part(items: object, name: str) -> Part:
    if "_" in name:
        return Stack([_axis(a, d) for a, d in zip(items, name.split("_"), strict=True)])
    return _axis(items, name)


def crange(start: object, stop: object, step: object, name: str | None = None) -> Axis | Stack:
    """By step; sequences of starts and stops make a stack."""
    if isinstance(start, (list, tuple)):
        names = name.split("_") if name else [None] * len(start)
        return Stack([UniformAxis(a, b, step=s, name=n) for a, b, s, n in zip(start, stop, step, names, strict=True)])
    return UniformAxis(start, stop, step=step, name=name)


def clinspace(start: object, stop: object, num: int, name: str | None = None) -> Axis | Stack:
    """By size; sequences of starts and stops make a stack."""
    if isinstance(start, (list, tuple)):
        names = name.split("_") if name else [None] * len(start)
        return Stack([UniformAxis(a, b, size=num, name=n) for a, b, n in zip(start, stop, names, strict=True)])
    return UniformAxis(start, stop, size=num, name=name)


def merge_dims(many: list[Coordinates]) -> Coordinates:
    """The product of disjoint coordinates in one CRS."""
    if len({crs_.kind(c.crs) for c in many}) > 1:
        raise ValueError("cannot merge coordinates of different CRS")
    return Coordinates([p for c in many for p in c.parts], crs=many[0].crs if many else crs_.DEFAULT)


def concat(many: list[Coordinates]) -> Coordinates:
    """Values appended dimension by dimension; duplicates stay."""
    first = many[0]
    if any(set(c.dims) != set(first.dims) for c in many):
        raise ValueError("cannot concatenate coordinates of different dimensions")
    joined = lambda d: Axis(np.concatenate([c.axis(d).coordinates for c in many]), d)
    return Coordinates([joined(p.name) if isinstance(p, Axis) else Stack([joined(d) for d in p.dims]) for p in first.parts], crs=first.crs)


def union(many: list[Coordinates]) -> Coordinates:
    return concat(many).unique()


class GroupCoordinates:
    """Requests with the same dimensions, evaluated together under a group number."""

    def __init__(self, items: list[Coordinates]):
        if any(set(c.udims) != set(items[0].udims) for c in items):
            raise ValueError("all requests of a group need the same dimensions")
        self.items = list(items)

    def append(self, c: Coordinates) -> None:
        if self.items and set(c.udims) != set(self.items[0].udims):
            raise ValueError("all requests of a group need the same dimensions")
        self.items.append(c)

    def __add__(self, other: GroupCoordinates) -> GroupCoordinates:
        return GroupCoordinates(self.items + other.items)

    def __len__(self) -> int:
        return len(self.items)

    def __getitem__(self, i: int) -> Coordinates:
        return self.items[i]

    def intersect(self, other: Coordinates, outer: bool = False) -> GroupCoordinates:
        return GroupCoordinates([c.intersect(other, outer=outer) for c in self.items])

    def frame(self, spark: SparkSession) -> DataFrame:
        frames = [c.frame(spark, index=False).select(F.lit(i).alias("group_id"), *self.items[0].udims) for i, c in enumerate(self.items)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
