"""Nodes over the operators: algorithms, reductions, compositors, interpolation, request rewrites."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from lodegrid.functions import timeunits as tu
from lodegrid.operators import algebra, climatology, composite, convolve, interpolate, reduce, rewrite
from lodegrid.plans.coordinates import Axis, Coordinates, Stack, UniformAxis, merge_dims
from lodegrid.plans.coverage import Coverage
from lodegrid.plans.node import Node, Request, coordinates_of
from lodegrid.plans.settings import settings


# -- algorithms ----------------------------------------------------------------------------------
class Algorithm(Node):
    """A user's operator: subclasses define ``algorithm(inputs, coordinates)`` over compiled inputs."""

    open_inputs = True
    input_names = ()

    def build(self, request: Request) -> Coverage:
        return self.algorithm({k: n.compile(request) for k, n in self.inputs.items()}, request.coords)

    def algorithm(self, inputs: dict[str, Coverage], coordinates: Coordinates) -> Coverage:
        raise NotImplementedError


class UnaryAlgorithm(Algorithm):
    input_names = ("source",)


class Arithmetic(Algorithm):
    """An expression over named inputs, after ``params`` are put in."""

    attributes = {"eqn": None, "params": None}

    def check(self) -> None:
        if not self.attrs["eqn"]:
            raise ValueError("Arithmetic needs an eqn")

    def algorithm(self, inputs, coordinates):
        return algebra.arithmetic(self.attrs["eqn"], inputs, self.attrs["params"])


class Generic(Algorithm):
    """Python over aligned inputs, in Arrow batches: a callable from a frame to a series, or (only where
    unsafe code is allowed) a text that assigns ``output``."""

    attributes = {"code": None}

    def algorithm(self, inputs, coordinates):
        code = self.attrs["code"]
        if callable(code):
            return algebra.custom(inputs, code)
        settings.require_unsafe()

        def run(frame):
            scope = {"np": np} | {n: frame[n] for n in inputs}
            exec(code, scope)  # noqa: S102
            return scope["output"]

        return algebra.custom(inputs, run)


class Mask(Algorithm):
    """Source cells where ``mask bool_op bool_val`` become ``masked_val``."""

    attributes = {"masked_val": None, "bool_val": 1, "bool_op": "=="}
    input_names = ("source", "mask")

    def algorithm(self, inputs, coordinates):
        a = self.attrs
        if self.inputs["source"] == self.inputs["mask"]:
            return algebra.mask_by_self(inputs["source"], a["masked_val"], a["bool_val"], a["bool_op"])
        return algebra.mask(inputs["source"], inputs["mask"], a["masked_val"], a["bool_val"], a["bool_op"])


class Combine(Algorithm):
    """Inputs as outputs; their coordinates must be equal."""

    def algorithm(self, inputs, coordinates):
        return algebra.combine(inputs)


# -- reductions ----------------------------------------------------------------------------------
class Reduce(UnaryAlgorithm):
    """Base of reductions over ``dims`` (all if none); a subclass may define ``reduce(series)`` instead of a name."""

    attributes = {"dims": None}
    fn: str | None = None

    def algorithm(self, inputs, coordinates):
        if self.fn is None:
            return reduce.reduce_custom(inputs["source"], self.reduce, self.attrs["dims"])
        return reduce.reduce(inputs["source"], self.fn, self.attrs["dims"], self.attrs.get("percentile"))

    def reduce(self, series) -> float:
        raise NotImplementedError


def _reduction(name: str, fn: str, doc: str) -> type[Reduce]:
    return type(name, (Reduce,), {"fn": fn, "__doc__": doc, "__module__": __name__})


Min = _reduction("Min", "min", "Least known value.")
Max = _reduction("Max", "max", "Greatest known value.")
Sum = _reduction("Sum", "sum", "Sum; of nothing it is 0.")
Count = _reduction("Count", "count", "Number of finite values.")
Mean = _reduction("Mean", "mean", "Mean of known values.")
Variance = _reduction("Variance", "var", "Population variance.")
StandardDeviation = _reduction("StandardDeviation", "std", "Population standard deviation.")
Skew = _reduction("Skew", "skew", "Population skewness.")
Kurtosis = _reduction("Kurtosis", "kurtosis", "Population excess kurtosis.")
Median = _reduction("Median", "median", "Exact median.")


class Percentile(Reduce):
    """Exact percentile with linear interpolation."""

    attributes = {"dims": None, "percentile": 50.0}
    fn = "percentile"


class GroupReduce(UnaryAlgorithm):
    """Reduce within calendar groups of time."""

    attributes = {"groupby": "dayofyear", "reduce_fn": "mean", "custom_reduce_fn": None}

    def algorithm(self, inputs, coordinates):
        return reduce.group_reduce(inputs["source"], self.attrs["groupby"], self.attrs["custom_reduce_fn"] or self.attrs["reduce_fn"])


class DayOfYear(GroupReduce):
    """Reduce within days of the year."""


class ResampleReduce(UnaryAlgorithm):
    """Reduce within time buckets "n,U"."""

    attributes = {"resample": "1,D", "reduce_fn": "mean", "custom_reduce_fn": None}

    def algorithm(self, inputs, coordinates):
        return reduce.resample(inputs["source"], self.attrs["resample"], self.attrs["custom_reduce_fn"] or self.attrs["reduce_fn"])


class DayOfYearWindow(UnaryAlgorithm):
    """Reduce within a circular window of days of the year; a subclass may define ``function(series)``. Values are scaled
    by the inputs ``scale_min`` and ``scale_max``, where given, and else by ``scale_float``."""

    attributes = {"window": 0, "scale_float": None, "rescale": False, "reduce_fn": "mean"}
    input_names = ("source", "scale_min", "scale_max")
    function: Callable | None = None

    def algorithm(self, inputs, coordinates):
        a = self.attrs
        fn = self.function if self.function is not None else a["reduce_fn"]
        given = a["scale_float"] or (None, None)
        ends = [inputs.get(n, given[k]) for k, n in enumerate(("scale_min", "scale_max"))]
        scale = ends if all(e is not None for e in ends) else None
        return reduce.day_of_year_window(inputs["source"], a["window"], fn, scale_float=scale, rescale=a["rescale"])


class BetaFitDayOfYear(UnaryAlgorithm):
    """Beta distribution by cell and day of year: outputs a, b and a value for each percentile."""

    attributes = {"percentiles": (), "window": 0, "scale_float": None}

    def algorithm(self, inputs, coordinates):
        a = self.attrs
        return climatology.beta_fit(inputs["source"], a["window"], list(a["percentiles"]), a["scale_float"])


class Convolution(UnaryAlgorithm):
    """Convolve with a kernel array, or a window by name ("mean,5", "gaussian,3,1"), over ``kernel_dims``."""

    attributes = {"kernel": None, "kernel_type": None, "kernel_dims": None}

    def check(self) -> None:
        a = self.attrs
        if a["kernel"] is not None and a["kernel_type"] is not None:
            raise TypeError("Convolution takes a kernel or a kernel_type, not both")
        if a["kernel"] is None and a["kernel_type"] is None:
            raise TypeError("Convolution needs a kernel or a kernel_type")
        if not a["kernel_dims"]:
            raise TypeError("Convolution needs kernel_dims")
        if self.weights().ndim != len(a["kernel_dims"]):
            raise TypeError("kernel_dims must name each dimension of the kernel")

    def weights(self) -> np.ndarray:
        a = self.attrs
        return np.asarray(a["kernel"], float) if a["kernel"] is not None else convolve.kernel(a["kernel_type"], len(a["kernel_dims"]))

    def build(self, request: Request) -> Coverage:
        w, names = self.weights(), list(self.attrs["kernel_dims"])
        # kernel dimensions that the request lacks are summed out
        for k in range(len(names) - 1, -1, -1):
            if names[k] not in request.coords.udims:
                w = w.sum(axis=k)
                del names[k]
        wide = []
        for p in request.coords.parts:
            size = w.shape[names.index(p.name)] if p.name in names else 1
            wide.append(_widened(p.simplify(), size) if isinstance(p, Axis) and size > 1 and p.size > 1 else p)
        bigger = Coordinates(wide, crs=request.coords.crs)
        c = self.inputs["source"].compile(request.at(bigger))
        lines = convolve.separable(w)
        out = c
        if lines is None:
            out = convolve.convolve(out, w, {d: bigger.axis(d).simplify() for d in names})
        else:  # a product of lines: one dimension after the other, so a cell is spread to as many as the lines are long
            for d, line in zip(names, lines, strict=True):
                out = convolve.convolve(out, line, {d: bigger.axis(d).simplify()})
        return out.within({d: request.coords.axis(d).bounds for d in names})


def _widened(a: Axis, size: int) -> Axis:
    """An axis with the cells before and after it that a kernel of ``size`` reaches; lists go on in the step of their
    ends, and stay as they are if they are not in order."""
    before, after = convolve.expansion(size)
    if not a.uniform:
        if not a.monotonic:
            return a
        v = a.coordinates
        lead, tail = v[1] - v[0], v[-1] - v[-2]
        return Axis(np.concatenate([[v[0] - lead * k for k in range(before, 0, -1)], v, [v[-1] + tail * k for k in range(1, after + 1)]]), a.name)
    lo = a.start - a.step * before
    last = lo + a.step * (a.size + before + after - 1)
    return UniformAxis(lo, last, step=a.step, name=a.name) if a.is_time else UniformAxis(lo, last, size=a.size + before + after, name=a.name)


# -- compositors ---------------------------------------------------------------------------------
class BaseCompositor(Node):
    """Several sources as one; subclasses define ``composite``. Outputs are those of ``outputs`` where given (missing
    where no source has one), else all that the sources have; ``auto_outputs`` wants sources that agree on having them."""

    attributes = {"source_coordinates": None, "interpolation": None, "dims": None, "auto_outputs": False}
    input_names = ("sources",)

    def chosen(self, request: Request) -> list[Node]:
        """The sources whose own coordinate lies within the request's bounds."""
        sources, own = list(self.inputs["sources"]), self.attrs["source_coordinates"]
        if own is None:
            return sources
        own = coordinates_of(own)
        if len(own.udims) != 1 or own.size != len(sources):
            raise ValueError("source_coordinates need one dimension and a value for each source")
        d = own.udims[0]
        if d not in request.coords.udims:
            return sources
        return [sources[i] for i in own.axis(d).select(request.coords.axis(d).bounds, outer=False, return_index=True)[1]]

    def compiled(self, request: Request) -> list[Coverage]:
        sources = self.chosen(request)
        if self.attrs["interpolation"] is not None:
            sources = [Interpolate(source=s, interpolation=self.attrs["interpolation"]) for s in sources]
        return [s.compile(request) for s in sources]

    def build(self, request: Request) -> Coverage:
        if self.attrs["dims"]:
            kept = [p for p in request.coords.parts if p.name in self.attrs["dims"]]
            request = request.at(Coordinates(kept, crs=request.coords.crs))
        parts = self.compiled(request)
        if not parts:
            frame = request.frame().select(*request.coords.udims, F.lit(None).cast("double").alias("value"))
            return Coverage(frame, tuple(request.coords.udims))
        if self.attrs["auto_outputs"] and len({c.outputs == ("value",) for c in parts}) > 1:
            raise ValueError("auto_outputs needs sources that all have outputs, or none")
        out, wanted = self.composite(parts, request), self.attrs.get("outputs")
        if not wanted:
            return out
        return out.with_df(out.df.select(*out.dims, *(F.col(o) if o in out.outputs else F.lit(None).cast("double").alias(o) for o in wanted)), outputs=list(wanted))

    def active(self, values: list[list[float | None]]) -> int | None:
        """Which of the sources gives the result at a point, from their values there."""
        return next((i for i, v in enumerate(values) if any(x is not None for x in v)), None)

    def composite(self, parts: list[Coverage], request: Request) -> Coverage:
        raise NotImplementedError


class OrderedCompositor(BaseCompositor):
    """The first finite value in order of the sources, at each requested cell."""

    def composite(self, parts, request):
        dims = [d for d in request.coords.udims if d in parts[0].dims]
        return composite.ordered(parts, request.frame(dims))


class TileCompositor(BaseCompositor):
    """The union of the sources' cells; earlier known values win."""

    def get_source_data(self, spark, bounds: dict[str, list] | None = None) -> Coverage:
        """The sources' own cells within bounds, composed, without interpolation."""
        sources = self.inputs["sources"]
        if any(not hasattr(s, "get_source_data") for s in sources):
            raise ValueError("all sources need get_source_data")
        return composite.tile([s.get_source_data(spark, bounds) for s in sources])

    def composite(self, parts, request):
        return composite.tile(parts)


# -- interpolation -------------------------------------------------------------------------------
METHODS = {"nearest", "nearest_preview", "linear", "bilinear", "quadratic", "cubic", "cubic_spline", "lanczos", "spline_2", "spline_3", "spline_4", "splinef2d", "zero", "slinear", "next", "previous", "average", "mode", "gauss", "max", "min", "med", "q1", "q3", "sum", "none"}
#: Degrees of the splines; "quadratic" takes parabolas.
SPLINES = {"quadratic": 2, "cubic": 3, "cubic_spline": 3, "splinef2d": 3, "spline_2": 2, "spline_3": 3, "spline_4": 4}
#: Requested axes of more values than this are not broadcast.
BROADCAST_CELLS = 1_000_000
AREA = {"average", "mode", "gauss", "max", "min", "med", "q1", "q3", "sum"}


#: Methods that users have added.
PLUGGED: dict[str, type[Interpolator]] = {}


class Interpolator:
    """A user's interpolation: ``methods`` names what it does; ``interpolate`` gets the source's cells, the dimensions
    to do, the source's axes (None where unknown and irregular), the requested coordinates and the parameters, and
    returns the cells at the request. Subclasses register by being defined."""

    methods: tuple[str, ...] = ()

    def __init_subclass__(cls, **kw: object) -> None:
        super().__init_subclass__(**kw)
        for name in cls.methods:
            if name in METHODS:
                raise ValueError(f"{name!r} is a method of the engine")
            PLUGGED[name] = cls

    def interpolate(self, c: Coverage, dims: list[str], axes: dict[str, Axis | None], asked: Coordinates, params: dict, spark) -> Coverage:
        raise NotImplementedError


class Interpolate(Node):
    """A source at the request's own coordinates. ``interpolation`` is a method, a dict with method, dims and
    params, or a list of such dicts in the order of execution; dimensions that are not named take "nearest"."""

    attributes = {"interpolation": "nearest"}

    def steps(self, dims: list[str]) -> list[tuple[str, list[str], dict]]:
        given = self.attrs["interpolation"]
        items = given if isinstance(given, list) else [given]
        out, named = [], []
        for item in items:
            item = {"method": item} if isinstance(item, str) else item
            if item["method"] not in METHODS and item["method"] not in PLUGGED:
                raise ValueError(f"unknown interpolation {item['method']!r}")
            own = [d for d in (item.get("dims") or dims) if d in dims and d not in named]
            named += own
            out.append((item["method"], own, item.get("params", {})))
        rest = [d for d in dims if d not in named]
        return out + ([("nearest", rest, {})] if rest else [])

    def find_coordinates(self):
        return self.inputs["source"].find_coordinates()

    def build(self, request: Request) -> Coverage:
        source = self.inputs["source"]
        found = source.find_coordinates()
        asked = request.coords
        if found and found[0].crs != asked.crs:
            asked = asked.transform(found[0].crs)
        inner = request.at(asked)
        inner.neighbours = True
        inner.open = {d: method for method, dims, _ in self.steps(asked.udims) for d in dims if method in ("previous", "zero", "next")}
        c = source.compile(inner)
        if not found and c.attrs.get("stacked"):
            points = c.attrs["stacked"].split("_")
            wanted = [d for d in asked.udims if d in points]
            return interpolate.nearest_scattered(c, request.at(asked).frame(wanted).select(*wanted), points, self._scales(), self._params().get("spatial_tolerance"))
        stacked = [p for f in found for p in f.parts if isinstance(p, Stack) and set(p.dims) <= set(c.dims)]
        if stacked:
            wanted = [d for d in asked.udims if d in stacked[0].dims]
            scales = self._scales()
            frame, tolerance = request.at(asked).frame(wanted).select(*wanted), self._params().get("spatial_tolerance")
            if stacked[0].size > interpolate.LISTED:
                return interpolate.nearest_scattered(c, frame, [d for d in stacked[0].dims if d in c.dims], scales, tolerance)
            return interpolate.nearest_listed(c, frame, stacked[0], scales, tolerance)
        for part in asked.parts:
            if isinstance(part, Stack) and len(set(part.dims) & set(c.dims)) > 1:
                return self._points(c, asked, part, found, request)
        own = {d: self._axis(c, d, found) for d in c.dims if d in asked.udims}
        steps = self.steps(list(own))
        for method, dims, params in steps:
            c = self._step(c, method, dims, params, asked, own, request)
        in_turn = sum(1 if method == "bilinear" and len(dims) == 2 else len(dims) for method, dims, _ in steps)
        if in_turn > 1 and not any(method in AREA or method == "none" for method, _, _ in steps):
            # one dimension after the other leaves out cells that the source lacks: they are missing, not absent
            cells = Coordinates([asked.axis(d) for d in own], crs=asked.crs).frame(request.spark).select(*own)
            c = c.with_df(cells.join(c.df, list(own), "left"))
        return c

    def _axis(self, c: Coverage, d: str, found: list[Coordinates]) -> Axis | None:
        """The source's axis: known at plan time, or inferred if it is uniform, else None."""
        for f in found:
            if any(isinstance(p, Axis) and p.name == d for p in f.parts):
                return f.axis(d).simplify()
        return interpolate.inferred_axis(c, d)

    def _step(self, c, method, dims, params, asked, own, request) -> Coverage:
        frame = lambda d: Coordinates([asked.axis(d)], crs=asked.crs).frame(request.spark)
        if method == "none":
            return c
        if method in PLUGGED:
            return PLUGGED[method]().interpolate(c, dims, {d: own[d] for d in dims}, asked, params, request.spark)
        if method in AREA:
            pairs = {d: (own[d], asked.axis(d).simplify()) for d in dims}
            return interpolate.area_resample(c, method, pairs)
        if params.get("fill_nan"):  # gaps along each dimension first
            for d in dims:
                c = interpolate.fill_missing(c, d)
        straight = method in ("bilinear", "linear", "slinear")
        regular = lambda d: own[d] is not None and own[d].uniform and own[d].size > 1
        if straight and len(dims) == 2 and all(regular(d) for d in dims):
            both = Coordinates([asked.axis(d) for d in dims], crs=asked.crs)
            first = tuple(_first(own[d], asked.axis(d)) for d in dims)
            return interpolate.bilinear(c, both.frame(request.spark), *dims, *(own[d] for d in dims), first=first)
        for d in dims:
            axis = own[d]
            if axis is not None and (asked.axis(d) == axis or asked.axis(d).issubset(axis) and method != "nearest_preview"):
                cells = frame(d).select(d)
                c = c.with_df(c.df.join(F.broadcast(cells) if asked.axis(d).size <= BROADCAST_CELLS else cells, d, "left_semi"))
            elif straight and regular(d):
                c = interpolate.linear(c, frame(d), d, axis, extrapolate=params.get("fill_value") == "extrapolate", first_pruned=_first(axis, asked.axis(d)))
            elif method in ("next", "previous", "zero"):
                c = interpolate.carried(c, c.df, d, asked.axis(d), frame(d), "next" if method == "next" else "previous")
            elif method in SPLINES:
                c = interpolate.spline(c, asked.axis(d), d, SPLINES[method], "parabola" if method == "quadratic" else "spline")
            elif method == "lanczos" and regular(d):
                c = interpolate.lanczos(c, frame(d), d, axis)
            elif method == "lanczos":
                raise ValueError(f"lanczos needs a uniform axis {d!r}")
            elif straight and (axis is None or axis.size > 1):
                c = interpolate.linear_sorted(c, frame(d), d, asked.axis(d))
            else:
                if method == "nearest_preview" and axis is not None and axis.uniform and asked.axis(d).size > 1:
                    want = abs((asked.axis(d).coordinates[-1] - asked.axis(d).coordinates[0]) / (asked.axis(d).size - 1))
                    c = interpolate.strided(c, d, axis, want if not isinstance(want, np.timedelta64) else tu.micros(want) / 1e6)
                tolerance = params.get({"time": "time_tolerance", "alt": "alt_tolerance", "lat": "spatial_tolerance", "lon": "spatial_tolerance"}.get(d, "other_dim_tolerance"))
                options = {"tolerance": tolerance, "respect_bounds": params.get("respect_bounds", True), "remove_nan": params.get("remove_nan", False)}
                if axis is None:
                    c = interpolate.nearest_sorted(c, frame(d), d, asked.axis(d), **options)
                elif axis.uniform:
                    c = interpolate.nearest_uniform(c, frame(d), d, axis, ties=params.get("ambiguous_rounding", "-infinity"), **options)
                else:
                    c = interpolate.nearest_irregular(c, frame(d), d, axis, **options)
        return c

    def _scales(self) -> dict[str, float]:
        keys = {"lat": "spatial_scale", "lon": "spatial_scale", "time": "time_scale", "alt": "alt_scale"}
        return {d: self._params()[k] for d, k in keys.items() if self._params().get(k)}

    def _params(self) -> dict:
        given = self.attrs["interpolation"]
        items = given if isinstance(given, list) else [given]
        return {k: v for i in items if isinstance(i, dict) for k, v in i.get("params", {}).items()}

    def _points(self, c: Coverage, asked: Coordinates, stack: Stack, found: list[Coordinates], request: Request) -> Coverage:
        """A stack of requested points over a gridded source."""
        axes = {d: self._axis(c, d, found) for d in stack.dims if d in c.dims}
        if not all(a is not None and a.uniform for a in axes.values()):
            raise ValueError("points over a gridded source need uniform axes")
        method = self.steps(list(axes))[0][0]
        frame = request.at(asked).frame([stack.name])
        if method in ("bilinear", "linear", "slinear") and len(axes) == 2:
            return interpolate.bilinear(c, frame, *axes, *axes.values(), first=tuple(_first(a, stack_axis(stack, d)) for d, a in axes.items()))
        return interpolate.nearest_at_points(c, frame, axes)


def stack_axis(stack: Stack, d: str) -> Axis:
    return next(a for a in stack.axes if a.name == d)


def _first(axis: UniformAxis, asked: Axis) -> int:
    """The first index of the source that any requested value needs."""
    low = asked.bounds[0]
    place = (tu.micros(low) - tu.micros(axis.values[0])) / tu.micros(axis.step) if axis.is_time else (low - axis.values[0]) / axis.step
    if axis.descending:
        high = asked.bounds[1]
        place = (tu.micros(high) - tu.micros(axis.values[0])) / tu.micros(axis.step) if axis.is_time else (high - axis.values[0]) / axis.step
    return int(max(0, min(axis.size - 2, np.floor(place + 1e-9))))


class Reproject(Node):
    """Evaluate on other coordinates first, then interpolate to the request."""

    attributes = {"coordinates": None, "reproject_dims": None, "interpolation": "nearest"}

    def build(self, request: Request) -> Coverage:
        given = self.attrs["coordinates"]
        own = given.find_coordinates()[0] if isinstance(given, Node) else coordinates_of(given)
        if self.attrs["reproject_dims"]:
            own = own.drop([d for d in own.dims if d not in self.attrs["reproject_dims"]])
        kept = own.intersect(request.coords, outer=True)
        rest = [p for p in request.coords.parts if p.name not in kept.udims]
        whole = merge_dims([kept, Coordinates(rest, crs=kept.crs)]) if rest else kept
        inner = Interpolate(source=self.inputs["source"], interpolation=self.attrs["interpolation"]) if not isinstance(self.inputs["source"], Interpolate) else self.inputs["source"]
        c = inner.compile(request.at(whole))
        frozen = Frozen(coverage=c, coordinates=whole, origin=inner.hash)
        return Interpolate(source=frozen, interpolation=self.attrs["interpolation"]).compile(request)


class ReprojectedSource(Reproject):
    """An older name of Reproject."""


class Frozen(Node):
    """A compiled coverage as a source on known coordinates."""

    attributes = {"coverage": None, "coordinates": None, "origin": None}
    input_names = ()

    def find_coordinates(self):
        return [self.attrs["coordinates"]]

    @property
    def hash(self) -> str:
        """Of what the coverage was made from: the node, and the coordinates it was asked for."""
        return f"frozen-{self.attrs['origin']}-{self.attrs['coordinates'].hash}"

    def build(self, request: Request) -> Coverage:
        return self.attrs["coverage"]


# -- request rewrites ----------------------------------------------------------------------------
class ModifyCoordinates(Node):
    """Base: evaluates the source at rewritten coordinates."""

    attributes = {"lat": None, "lon": None, "time": None, "alt": None, "substitute_eval_coords": False}

    def rewritten(self, axis: Axis, item: object) -> Axis:
        raise NotImplementedError

    def build(self, request: Request) -> Coverage:
        parts = [self.rewritten(p, self.attrs[p.name]) if isinstance(p, Axis) and self.attrs.get(p.name) is not None else p for p in request.coords.parts]
        for p in parts:
            if p.size == 0:
                raise ValueError(f"the modified coordinates of {p.name!r} are empty")
        new = Coordinates(parts, crs=request.coords.crs)
        out = self.inputs["source"].compile(request.at(new))
        if self.attrs.get("substitute_eval_coords"):
            for p, q in zip(request.coords.parts, new.parts, strict=True):
                if isinstance(p, Axis) and p.name in out.dims and p != q:
                    out = rewrite.substitute_back(out, p.frame(request.spark), q.frame(request.spark), p.name)
        return out

    def available(self, d: str) -> Axis:
        found = [c.axis(d) for c in self.inputs["source"].find_coordinates() if d in c.udims]
        if not found:
            raise ValueError(f"the source knows no coordinates of {d!r}; give a step")
        return found[0]


class ExpandCoordinates(ModifyCoordinates):
    """(start, stop) around each value: the source's own coordinates within; (start, stop, step): generated."""

    attributes = ModifyCoordinates.attributes | {"bounds_only": False}

    def rewritten(self, axis: Axis, item: object) -> Axis:
        start, stop = (tu.step(v) for v in item[:2])
        move = lambda v, s: tu.add(v, s) if isinstance(s, np.timedelta64) else v + s
        centres = axis.coordinates
        spans = [(move(centres[0], start), move(centres[-1], stop))] if self.attrs["bounds_only"] else [(move(v, start), move(v, stop)) for v in centres]
        pieces = [UniformAxis(a, b, step=item[2], name=axis.name).coordinates if len(item) > 2 else self.available(axis.name).select((a, b)).coordinates for a, b in spans]
        return Axis(np.concatenate(pieces), axis.name)


class SelectCoordinates(ModifyCoordinates):
    """One value (a point), two (bounds over the source's coordinates) or three (start, stop, step)."""

    def rewritten(self, axis: Axis, item: object) -> Axis:
        values = list(item) if isinstance(item, (list, tuple)) else [item]
        if len(values) == 3:
            return UniformAxis(values[0], values[1], step=values[2], name=axis.name)
        if len(values) == 1 or tu.value(values[0]) == tu.value(values[1]):
            return Axis([values[0]], axis.name)
        return self.available(axis.name).select(values)


class YearSubstituteCoordinates(ModifyCoordinates):
    """The request's times moved to another year."""

    attributes = ModifyCoordinates.attributes | {"year": None}

    def build(self, request: Request) -> Coverage:
        def moved(axis: Axis) -> Axis:
            years = lambda t: int(str(self.attrs["year"])) - (1970 + int(t.astype("datetime64[Y]").astype(int)))
            return Axis([tu.add(t, np.timedelta64(years(t), "Y")) for t in axis.coordinates], axis.name)

        parts = [moved(p) if p.name == "time" else p for p in request.coords.parts]
        out = self.inputs["source"].compile(request.at(Coordinates(parts, crs=request.coords.crs)))
        if self.attrs["substitute_eval_coords"]:
            old = next(p for p in request.coords.parts if p.name == "time")
            new = next(p for p in parts if p.name == "time")
            out = rewrite.substitute_back(out, old.frame(request.spark), new.frame(request.spark), "time")
        return out


class TransformTimeUnits(Node):
    """Time replaced by a calendar part."""

    attributes = {"time_units": "day"}

    def build(self, request: Request) -> Coverage:
        return rewrite.transform_time(self.inputs["source"].compile(request), self.attrs["time_units"])
