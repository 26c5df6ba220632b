"""Source nodes. A source answers with its own cells within the request's bounds, one more on each side
where interpolation may need it; ``Interpolate`` on top gives values at the request itself."""

from __future__ import annotations

import importlib.util

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.operators import algebra
from lodegrid.plans.coordinates import Axis, Coordinates, Stack, index_column, literal
from lodegrid.plans.coverage import Coverage
from lodegrid.plans.node import Node, Request, coordinates_of
from lodegrid.sources import tables, zarr


class DataSource(Node):
    """Base of sources: subclasses give ``get_coordinates`` (where known at plan time) and ``get_data``."""

    attributes = {"nan_vals": None, "boundary": None, "coordinates": None}
    input_names = ()

    def get_coordinates(self) -> Coordinates | None:
        return coordinates_of(self.attrs["coordinates"]) if self.attrs.get("coordinates") is not None else None

    def get_data(self, spark) -> Coverage:
        raise NotImplementedError

    def find_coordinates(self) -> list[Coordinates]:
        c = self.get_coordinates()
        return [c] if c is not None else []

    def get_source_data(self, spark, bounds: dict[str, list] | None = None) -> Coverage:
        """The cells as they are, within bounds if given."""
        return self._clean(self.get_data(spark)).within(bounds or {})

    def _clean(self, c: Coverage) -> Coverage:
        if self.attrs.get("nan_vals"):
            bad = [float(v) for v in self.attrs["nan_vals"]]
            c = c.mapped(lambda v: F.when(v.isin(bad), None).otherwise(v))
        return tables.with_boundary(c, self.attrs["boundary"]) if self.attrs.get("boundary") else c

    def missing_dims(self, request: Request, dims: tuple[str, ...], stacked: list[str]) -> list[str]:
        own = self.get_coordinates()
        stacks = [p.dims for p in own.parts if isinstance(p, Stack)] if own is not None else [stacked] if stacked else []
        have = set(request.coords.udims)
        single = [d for d in dims if not any(d in s for s in stacks)]
        return [d for d in single if d not in have] + ["_".join(s) for s in stacks if not set(s) & have]

    def build(self, request: Request) -> Coverage:
        data = self.get_source_data(request.spark)
        points = (data.attrs.get("stacked") or "").split("_") if data.attrs.get("stacked") else []
        if missing := self.missing_dims(request, data.dims, points):
            raise ValueError(f"the request lacks the source's dimensions {missing}")
        own = self.get_coordinates()
        asked = request.coords
        if own is not None and own.crs != asked.crs:
            asked = asked.transform(own.crs)
        bounds, loose = {}, {}
        for d, b in asked.bounds.items():
            if d not in data.dims:
                continue
            if own is not None and any(isinstance(p, Axis) and p.name == d for p in own.parts):
                kept = own.axis(d).select(b, outer=True)
                if not kept.size:
                    return data.with_df(data.df.limit(0))
                b = kept.bounds
            elif own is not None and any(isinstance(p, Stack) and d in p.dims for p in own.parts):
                if request.neighbours:
                    continue
                kept = own.axis(d).select(b, outer=True)
                b = kept.bounds if kept.size else b
            elif request.neighbours:
                if d not in points:
                    loose[d] = b
                continue
            bounds[d] = b
        return _with_neighbours(data.within(bounds), loose, request.open)


def _with_neighbours(data: Coverage, bounds: dict[str, list], open_: dict[str, str]) -> Coverage:
    """The cells within bounds and the next ones beyond them, of dimensions whose coordinates nobody declared: one
    aggregate of one row finds those values. Along dimensions that carry values on, that side stays open."""
    if not bounds:
        return data
    stamped = {d: isinstance(data.df.schema[d].dataType, T.TimestampType) for d in bounds}
    x = lambda d: F.unix_micros(d) if stamped[d] else F.col(d).cast("double")
    ends = data.df.agg(
        *(F.max(F.when(F.col(d) <= literal(lo), x(d))).alias(f"lo_{d}") for d, (lo, _) in bounds.items()),
        *(F.min(F.when(F.col(d) >= literal(hi), x(d))).alias(f"hi_{d}") for d, (_, hi) in bounds.items()),
    ).head()
    df = data.df
    for d, (lo, hi) in bounds.items():
        at = lambda v, given: literal(given) if v is None else F.timestamp_micros(F.lit(v)) if stamped[d] else F.lit(v)  # noqa: B023, E731
        if open_.get(d) not in ("previous", "zero"):
            df = df.where(F.col(d) >= at(ends[f"lo_{d}"], lo))
        if open_.get(d) != "next":
            df = df.where(F.col(d) <= at(ends[f"hi_{d}"], hi))
    return data.with_df(df)


class Table(DataSource):
    """A DataFrame, or a path in a format that Spark reads, seen as a coverage: a grid of its dimensions, or points where
    ``stacked`` names the dimensions that belong together ("lat_lon")."""

    attributes = DataSource.attributes | {"table": None, "path": None, "format": "parquet", "dims": (), "data": None, "rename": None, "stacked": None}

    def get_data(self, spark) -> Coverage:
        if self.attrs["table"] is not None:
            df = tables.zoned(self.attrs["table"])
        elif self.attrs["format"] == "parquet":
            df = tables.read_parquet(spark, self.attrs["path"])
        else:
            df = tables.zoned(spark.read.format(self.attrs["format"]).load(self.attrs["path"]))
        if self.attrs["rename"]:
            df = df.withColumnsRenamed(self.attrs["rename"])
        data = self.attrs["data"]
        outs = [data] if isinstance(data, str) else data
        c = Coverage.of(df, list(self.attrs["dims"]), outs, stacked=self.attrs["stacked"])
        return c.renamed({c.outputs[0]: "value"}) if len(c.outputs) == 1 else c


class Array(DataSource):
    """An in-memory array over coordinates, row-major; a last axis beyond the coordinates' holds outputs."""

    attributes = DataSource.attributes | {"source": None}

    def check(self) -> None:
        values = np.asarray(self.attrs["source"])
        if values.dtype.kind not in "fiub":
            raise ValueError("array sources must be numeric")

    def get_data(self, spark) -> Coverage:
        coords = self.get_coordinates()
        values = np.asarray(self.attrs["source"], float)
        outs = list(self.attrs.get("outputs") or ["value"])
        flat = values.reshape(coords.size, -1)
        if flat.shape[1] != len(outs):
            raise ValueError(f"shape {values.shape} does not fit {coords.shape} and outputs {outs}")
        lists = [F.lit([None if np.isnan(v) else float(v) for v in flat[:, k]]) if not np.isnan(flat[:, k]).all() else F.array_repeat(F.lit(None).cast("double"), coords.size) for k in range(len(outs))]
        at = F.lit(0)
        for p in coords.parts:
            at = at * p.size + F.col(index_column(p.name))
        frame = coords.frame(spark)
        cells = frame.select(*coords.udims, *(F.element_at(a, (at + 1).cast("int")).alias(o) for a, o in zip(lists, outs, strict=True)))
        return Coverage(cells, tuple(coords.udims), tuple(outs))


class CSV(DataSource):
    """A CSV file of points; see ``lodegrid.sources.tables.csv``."""

    attributes = DataSource.attributes | {"source": None, "header": 0, "lat_key": None, "lon_key": None, "alt_key": None, "time_key": None, "data_key": None}

    def get_data(self, spark) -> Coverage:
        a = self.attrs
        return tables.csv(spark, a["source"], a["header"] is not None, a["lat_key"], a["lon_key"], a["alt_key"], a["time_key"], a["data_key"])


class Overviews(Node):
    """Levels of one source, each on a coarser grid: a request reads the coarsest level that is at least as
    fine as itself (``closest``: the level whose step is nearest to the request's)."""

    attributes = {"steps": (), "dim": "lat", "closest": False}
    input_names = ("levels",)

    def pick(self, coords: Coordinates) -> int:
        axis = coords.axis(self.attrs["dim"])
        steps = [float(s) for s in self.attrs["steps"]]
        if axis.size < 2:
            return steps.index(min(steps))
        wanted = abs(float(axis.coordinates[-1] - axis.coordinates[0])) / (axis.size - 1)
        if self.attrs["closest"]:
            return min(range(len(steps)), key=lambda i: abs(steps[i] - wanted))
        fine = [i for i, s in enumerate(steps) if s <= wanted * (1 + 1e-9)]
        return max(fine, key=lambda i: steps[i]) if fine else steps.index(min(steps))

    def find_coordinates(self) -> list[Coordinates]:
        return self.inputs["levels"][0].find_coordinates()

    def build(self, request: Request) -> Coverage:
        return self.inputs["levels"][self.pick(request.coords)].compile(request)


class _Generated(Node):
    input_names = ()

    def build(self, request: Request) -> Coverage:
        return self.made(request.frame(), request.coords)


class Arange(_Generated):
    """0 to size-1 over the request, row-major."""

    def made(self, frame, coords: Coordinates) -> Coverage:
        at = F.lit(0)
        for p in coords.parts:
            at = at * p.size + F.col(index_column(p.name))
        return Coverage(frame.select(*coords.udims, at.cast("double").alias("value")), tuple(coords.udims))


class CoordData(_Generated):
    """The values of one dimension as data."""

    attributes = {"coord_name": None}

    def made(self, frame, coords: Coordinates) -> Coverage:
        return algebra.coordinate_data(frame, coords.udims, self.attrs["coord_name"])


class SinCoords(_Generated):
    """The product of sine waves along the dimensions."""

    def made(self, frame, coords: Coordinates) -> Coverage:
        return algebra.sine_waves(frame, coords.udims)


class MissingLibrary(ImportError):
    pass


class _External(DataSource):
    """Sources whose files need a library or a network that is not part of the engine. With the library at
    hand their ``load`` reads on the driver into a small coverage; large stores belong into Parquet."""

    attributes = DataSource.attributes | {"source": None, "data_key": None, "lat_key": "lat", "lon_key": "lon", "time_key": "time", "alt_key": "alt", "layer": None, "band": 1}
    library = ""

    def get_data(self, spark) -> Coverage:
        if importlib.util.find_spec(self.library) is None:
            raise MissingLibrary(f"{type(self).__name__} needs the library {self.library!r}")
        return self.load(spark)

    def load(self, spark) -> Coverage:
        raise NotImplementedError(f"{type(self).__name__} reads through {self.library!r}; convert its data to Parquet and use Table")


class Dataset(_External):
    """netCDF and the like through xarray."""

    library = "xarray"

    def load(self, spark) -> Coverage:
        xr = importlib.import_module("xarray")
        frame = xr.open_dataset(self.attrs["source"])[self.attrs["data_key"]].to_dataframe(name="value").reset_index()
        dims = [d for d in ("time", "lat", "lon", "alt") if d in frame]
        return Coverage.of(spark.createDataFrame(frame[[*dims, "value"]]), dims)


class H5PY(_External):
    """HDF5 by key path."""

    library = "h5py"

    def load(self, spark) -> Coverage:
        h5 = importlib.import_module("h5py")
        a = self.attrs
        with h5.File(a["source"]) as f:
            axes = [Axis(f[a[f"{d}_key"]][:].astype(float), d) for d in ("lat", "lon", "alt") if a[f"{d}_key"] in f]
            return Array(source=f[a["data_key"]][:], coordinates=Coordinates(axes)).get_data(spark)


class Zarr(DataSource):
    """A Zarr store: arrays of ``data_key`` (a name, or several as outputs; the only one with more than one dimension if
    none is named) over the coordinate arrays that their dimensions name. Chunks are decoded by the executors."""

    attributes = DataSource.attributes | {"source": None, "data_key": None, "lat_key": "lat", "lon_key": "lon", "time_key": "time", "alt_key": "alt", "dims": None}

    def _store(self, spark) -> zarr.Store:
        return zarr.Store(spark, self.attrs["source"])

    def _layouts(self, store: zarr.Store) -> dict[str, zarr.Layout]:
        given = self.attrs["data_key"]
        if given is not None:
            return {k: store.layout(k) for k in ([given] if isinstance(given, str) else given)}
        keys = {self.attrs[f"{d}_key"] for d in ("lat", "lon", "time", "alt")}
        found = {k: store.layout(k) for k in store.keys() if k not in keys}
        if not found:
            raise ValueError("No data keys found")
        return found

    def _axes(self, store: zarr.Store, layout: zarr.Layout) -> list[Axis]:
        names = {self.attrs[f"{d}_key"]: d for d in ("lat", "lon", "time", "alt")}
        axes = []
        for key in layout.dims or [self.attrs.get(f"{d}_key", d) for d in self.attrs["dims"] or ()]:
            values, own = store.axis(key)
            units = own.attributes.get("units", "")
            axes.append(Axis(zarr.decoded_times(values, units) if " since " in units else values, names.get(key, key)))
        if len(axes) != len(layout.shape):
            raise ValueError(f"an array of shape {layout.shape} needs the names of its dimensions; give dims")
        return axes

    def get_coordinates(self) -> Coordinates:
        if self.attrs.get("coordinates") is not None:
            return coordinates_of(self.attrs["coordinates"])
        store = self._store(SparkSession.getActiveSession())
        return Coordinates(self._axes(store, next(iter(self._layouts(store).values()))))

    def get_data(self, spark) -> Coverage:
        store = self._store(spark)
        layouts, coords = self._layouts(store), self.get_coordinates()
        df, index = None, [f"__i_{k}" for k in range(len(coords.parts))]
        for key, layout in layouts.items():
            if layout.shape != coords.shape:
                raise ValueError(f"array {key!r} of shape {layout.shape} does not fit coordinates of shape {coords.shape}")
            cells = store.cells(key, layout, "value" if len(layouts) == 1 else key)
            df = cells if df is None else df.join(cells, index)
        for k, axis in enumerate(coords.parts):
            frame = axis.simplify().frame(spark)
            df = df.join(F.broadcast(frame.withColumnRenamed(index_column(axis.name), index[k])), index[k])  # a list of the plan
        return Coverage.of(df, coords.udims, ["value"] if len(layouts) == 1 else list(layouts))


class ZarrMemory(Zarr):
    """A Zarr store in memory: ``source`` is a dict of names and bytes."""


class Rasterio(_External):
    """Any raster that GDAL reads."""

    library = "rasterio"

    def load(self, spark) -> Coverage:
        rio = importlib.import_module("rasterio")
        with rio.open(self.attrs["source"]) as f:
            coords = Coordinates.from_geotransform(f.transform.to_gdal(), f.shape)
            return Array(source=f.read(self.attrs["band"]), coordinates=coords, nan_vals=[f.nodata] if f.nodata is not None else None).get_data(spark)


class PyDAP(_External):
    """OpenDAP; needs a network."""

    library = "pydap"


class WCS(_External):
    """OGC coverages; needs a network."""

    library = "owslib"


class OGR(_External):
    """Vector layers burnt onto the request's grid."""

    library = "osgeo"


def schema_of(c: Coverage) -> T.StructType:
    return c.df.schema
