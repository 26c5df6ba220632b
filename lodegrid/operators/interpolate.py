"""Interpolation as joins.

Requests are tables with a row for each wanted cell; sources are coverages. Uniform axes meet by an
integer index computed from the value, so a join is an equi-join of whole numbers. Irregular axes are
looked up by buckets between midpoints. Nothing compares all pairs: scattered points meet through the
cells of a coarse grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.functions import timeunits as tu
from lodegrid.plans.coordinates import Axis, Stack, UniformAxis
from lodegrid.plans.coverage import Coverage

TIES = {"-infinity": lambda x: F.ceil(x - 0.5), "+infinity": lambda x: F.floor(x + 0.5), "unbiased": F.rint}


def number(v: Column, df: DataFrame, name: str) -> Column:
    """A dimension as DOUBLE: times are microseconds since the epoch."""
    return F.unix_micros(v).cast("double") if isinstance(df.schema[name].dataType, T.TimestampType) else v.cast("double")


def axis_index(v: Column, axis: UniformAxis) -> Column:
    """The fractional position of a value on a uniform axis."""
    if axis.is_time:
        return (F.unix_micros(v) - F.lit(tu.micros(axis.values[0]))) / F.lit(float(tu.micros(axis.step)))
    return (v - F.lit(float(axis.values[0]))) / F.lit(float(axis.step))


def whole_index(v: Column, axis: UniformAxis) -> Column:
    """The position of a source cell: rounded, so that floating-point noise does not matter."""
    return F.rint(axis_index(v, axis)).cast("long")


def nearest_uniform(
    source: Coverage,
    request: DataFrame,
    dim: str,
    axis: UniformAxis,
    ties: str = "-infinity",
    tolerance: float | None = None,
    respect_bounds: bool = True,
    remove_nan: bool = False,
) -> Coverage:
    """The source cell nearest to each requested value of one dimension, by index arithmetic.

    Half-way values go down by default. Up to half a cell beyond the ends still counts; farther is
    missing, or the end cell with ``respect_bounds=False``. ``tolerance`` is a distance in the axis's
    unit (seconds for time). Other dimensions of the source stay; a request may share them.
    """
    place = axis_index(F.col(dim), axis)
    index = TIES[ties](place).cast("long")
    inside = (index >= 0) & (index < axis.size)
    key = F.when(inside, index) if respect_bounds else F.greatest(F.lit(0), F.least(index, F.lit(axis.size - 1)))
    if tolerance is not None:
        width = abs(tu.micros(axis.step)) / 1e6 if axis.is_time else abs(float(axis.step))
        key = F.when(F.abs(place - index) * width <= tolerance, key)
    return _lookup(source, request, dim, key, whole_index(F.col(dim), axis), remove_nan)


def _lookup(source: Coverage, request: DataFrame, dim: str, key: Column, own: Column, remove_nan: bool) -> Coverage:
    src = source.df
    if remove_nan:
        for o in source.outputs:
            src = src.where(F.col(o).isNotNull())
    src = src.withColumn("__k", own).drop(dim)
    others = [d for d in source.dims if d != dim]
    shared = [d for d in others if d in request.columns]
    free = [d for d in others if d not in request.columns]
    joined = request.withColumn("__k", key).join(src, ["__k", *shared], "left")
    keep = [d for d in request.columns if not d.startswith("__i_")]
    out = joined.select(*keep, *free, *source.outputs)
    for d in free:
        out = out.where(F.col(d).isNotNull())
    return source.with_df(out, dims=[*keep, *free])


def nearest_irregular(source: Coverage, request: DataFrame, dim: str, axis: Axis, tolerance: float | None = None, respect_bounds: bool = True, remove_nan: bool = False) -> Coverage:
    """The same on a listed axis (a plan-time list of the source's coordinates, sorted here). A value
    half-way between two points takes the lower one; outside the points' range it is missing."""
    points = np.sort(np.array([tu.micros(v) if axis.is_time else float(v) for v in axis.coordinates], float))
    v = number(F.col(dim), request, dim)
    middles = F.lit(((points[:-1] + points[1:]) / 2).tolist()) if len(points) > 1 else F.array().cast("array<double>")
    # the bucket is the number of midpoints below the value
    index = F.aggregate(middles, F.lit(0), lambda n, m: n + (m < v).cast("int")) if len(points) <= 64 else _rank(v, points)
    hit = F.element_at(F.lit(points.tolist()), index + 1)
    good = F.lit(True)
    if respect_bounds:
        good = good & (v >= points[0]) & (v <= points[-1])
    if tolerance is not None:
        good = good & (F.abs(v - hit) <= tolerance * (1e6 if axis.is_time else 1.0))
    return _lookup(source, request, dim, F.when(good, hit), number(F.col(dim), source.df, dim), remove_nan)


def _rank(v: Column, points: np.ndarray) -> Column:
    """How many midpoints lie below v, by a balanced tree of comparisons."""
    middles = (points[:-1] + points[1:]) / 2

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > float(middles[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(middles))


def position(v: Column, asked: Axis) -> Column:
    """How many of a request's distinct values lie below v (a number, times in microseconds). Uniform axes do it by
    arithmetic; lists are cut into cells of equal width, so a value is compared with the points of one cell only."""
    if asked.uniform and asked.size > 1 and not (asked.is_time and tu.nominal(asked.step)):
        n = asked.size
        start, step = (tu.micros(asked.values[0]), tu.micros(asked.step)) if asked.is_time else (float(asked.values[0]), float(asked.step))
        point = lambda k: F.lit(float(start)) + (k if step > 0 else n - 1 - k) * F.lit(float(step))
        low = start if step > 0 else start + (n - 1) * step
        k = F.least(F.greatest(F.ceil((v - F.lit(float(low))) / F.lit(float(abs(step)))), F.lit(0)), F.lit(n)).cast("long")
        k = F.when((k > 0) & (point(k - 1) >= v), k - 1).otherwise(k)
        return F.when((k < n) & (point(k) < v), k + 1).otherwise(k)
    points = np.unique(np.array([tu.micros(x) if asked.is_time else float(x) for x in asked.coordinates], float))
    if len(points) <= 64:
        return F.aggregate(F.lit(points.tolist()), F.lit(0).cast("long"), lambda n, p: n + (p < v).cast("long"))
    width = (points[-1] - points[0]) / len(points)
    cell = lambda x: F.least(F.greatest(F.floor((x - F.lit(float(points[0]))) / F.lit(float(width))), F.lit(0)), F.lit(len(points) - 1)).cast("int")
    at = np.clip(np.floor((points - points[0]) / width), 0, len(points) - 1).astype(int)
    before = np.searchsorted(at, np.arange(len(points))).tolist()
    ends = np.searchsorted(at, np.arange(len(points)), side="right").tolist()
    listed = F.lit(points.tolist())
    here = F.slice(listed, F.get(F.lit(before), cell(v)) + 1, F.get(F.lit(ends), cell(v)) - F.get(F.lit(before), cell(v)))
    return F.get(F.lit(before), cell(v)).cast("long") + F.aggregate(here, F.lit(0).cast("long"), lambda n, p: n + (p < v).cast("long"))


def range_column(df: DataFrame, dim: str) -> Column:
    """A number for each of as many ranges of ``dim`` as a shuffle has partitions, about equally filled: what splits the
    work of a source without other dimensions. The bounds are a sketch's quantiles, one short list in the plan."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(number(F.col(dim), df, dim).alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    return position(number(F.col(dim), df, dim), Axis(sorted(set(cuts)) or [0.0], None))


def brackets(source: DataFrame, dim: str, asked: Axis, request: DataFrame) -> DataFrame:
    """``request`` (rows of the plan-time axis ``asked``) with __i_x, its value as a number, and __i_below and __i_above,
    the nearest values of ``dim`` in the source on either side (itself where the source has it, null beyond the ends).

    One aggregate over the source, partial in each task, to the least and greatest value between two neighbours of the
    request; the running values after that go over rows of the request only."""
    v = number(F.col(dim), source, dim)
    groups = source.select(v.alias("v")).groupBy(position(F.col("v"), asked).alias("__i_j")).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    x = number(F.col(dim), request, dim)
    own = request.withColumns({"__i_x": x, "__i_j": position(x, asked)})
    both = own.select("__i_j", "__i_x").distinct().join(groups, "__i_j", "full_outer")
    below = F.max("most").over(Window.orderBy("__i_j").rowsBetween(Window.unboundedPreceding, 0))
    above = F.min("least").over(Window.orderBy(F.desc("__i_j")).rowsBetween(Window.unboundedPreceding, -1))
    above = F.when(F.col("most") == F.col("__i_x"), F.col("__i_x")).otherwise(above)
    found = both.select("__i_j", "__i_x", below.alias("__i_below"), above.alias("__i_above")).where("__i_x is not null").drop("__i_x")
    return own.join(found, "__i_j").drop("__i_j")


def inferred_axis(c: Coverage, dim: str) -> UniformAxis | Axis | None:
    """The axis of a source that declares none: uniform, or of one value, or None. Two aggregates of one row each, so
    no list of values comes to the driver."""
    stamped = isinstance(c.df.schema[dim].dataType, T.TimestampType)
    v = F.unix_micros(dim) if stamped else F.col(dim).cast("double")
    lo, hi, n = c.df.agg(F.min(v), F.max(v), F.count_distinct(v)).head()
    value = (lambda x: np.datetime64(int(x), "us")) if stamped else float
    if n < 2:
        return Axis([value(lo)], dim) if n else None
    step = (hi - lo) / (n - 1)
    place = (v - F.lit(lo)) / F.lit(float(step))
    off = c.df.agg(F.max(F.abs(place - F.rint(place)))).head()[0]
    return UniformAxis(value(lo), value(hi), size=int(n), name=dim) if off <= 1e-9 and (not stamped or (hi - lo) % (n - 1) == 0) else None


def nearest_sorted(source: Coverage, request: DataFrame, dim: str, asked: Axis, tolerance: float | None = None, respect_bounds: bool = True, remove_nan: bool = False) -> Coverage:
    """The source cell nearest to each requested value of a dimension without a known axis: the rules of
    ``nearest_irregular``, for sources of any size."""
    src = source.df
    for o in source.outputs if remove_nan else ():
        src = src.where(F.col(o).isNotNull())
    near = brackets(src, dim, asked, request)
    x, lo, hi = F.col("__i_x"), F.col("__i_below"), F.col("__i_above")
    pick = F.when(lo.isNull(), hi).when(hi.isNull(), lo).when(x - lo <= hi - x, lo).otherwise(hi)
    good = lo.isNotNull() & hi.isNotNull() if respect_bounds else F.lit(True)
    if tolerance is not None:
        good = good & (F.abs(x - pick) <= tolerance * (1e6 if asked.is_time else 1.0))
    return _lookup(source, near.withColumn("__i_pick", F.when(good, pick)), dim, F.col("__i_pick"), number(F.col(dim), source.df, dim), remove_nan)


def linear_sorted(source: Coverage, request: DataFrame, dim: str, asked: Axis) -> Coverage:
    """Linear between the neighbours of each requested value of a dimension without a known axis. An exact hit stands
    for itself; outside the source, or beside a missing cell, the result is missing."""
    keep = [c for c in request.columns if not c.startswith("__i_")]
    shared = [d for d in source.dims if d != dim and d in keep]
    free = [d for d in source.dims if d != dim and d not in keep]
    near = brackets(source.df, dim, asked, request)
    x, lo, hi = F.col("__i_x"), F.col("__i_below"), F.col("__i_above")
    w = F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))
    ends = F.when(lo == hi, F.array(F.struct(lo.alias("k"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(lo.alias("k"), (1 - w).alias("w")), F.struct(hi.alias("k"), w.alias("w"))))
    ends = F.when(lo.isNotNull() & hi.isNotNull(), ends).otherwise(F.array(F.struct(F.lit(None).cast("double").alias("k"), F.lit(0.0).alias("w"))))
    asks = near.select(*keep, F.size(ends).alias("__n"), F.explode(ends).alias("__e")).select(*keep, "__n", F.col("__e.k").alias("__k"), F.col("__e.w").alias("__w"))
    src = source.df.select(*shared, *free, number(F.col(dim), source.df, dim).alias("__k"), *source.outputs)
    joined = asks.join(src, ["__k", *shared], "left")
    outs = [F.when(F.count(o) == F.max("__n"), F.sum(F.col(o) * F.col("__w"))).alias(o) for o in source.outputs]
    out = joined.groupBy(*keep, *free).agg(*outs)
    for d in free:
        out = out.where(F.col(d).isNotNull())
    return source.with_df(out, dims=[*keep, *free])


def carried(source: Coverage, keys: DataFrame | None, dim: str, asked: Axis, request: DataFrame, direction: str = "previous", tolerance: float | None = None) -> Coverage:
    """The last known cell at or before each value of the plan-time axis ``asked`` (``next``: the first at or after), for
    each combination of the other dimensions (``keys``).

    Source cells shrink to one for each key and gap of the request before anything is shuffled; what is carried along
    the request is that, so a hot key is as long as the request and no longer."""
    others, outs = [d for d in source.dims if d != dim], list(source.outputs)
    src = source.df
    for o in outs:
        src = src.where(F.col(o).isNotNull())
    x = number(F.col(dim), src, dim)
    src = src.withColumns({"__x": x, "__j": position(x, asked)})
    if direction == "next":  # a cell serves the values up to the last one that is not above it
        hits = request.select(number(F.col(dim), request, dim).alias("__at")).distinct()
        hits = hits.select(position(F.col("__at"), asked).alias("__j"), "__at")
        src = src.join(F.broadcast(hits) if asked.size <= 1_000_000 else hits, "__j", "left")
        src = src.withColumn("__j", F.when(F.col("__x") == F.col("__at"), F.col("__j")).otherwise(F.col("__j") - 1)).where("__j >= 0")
    best = (F.max if direction == "previous" else F.min)(F.struct("__x", *outs))
    cells = src.groupBy(*others, "__j").agg(best.alias("__hit")).withColumns({"__side": F.lit(0), dim: F.lit(None).cast(request.schema[dim].dataType)})
    asks = request.select(dim).withColumn("__j", position(number(F.col(dim), request, dim), asked))
    asks = keys.select(*others).distinct().crossJoin(asks) if others else asks
    asks = asks.withColumns({"__side": F.lit(1), "__hit": F.lit(None).cast(cells.schema["__hit"].dataType)})
    order = Window.partitionBy(*others).orderBy(F.col("__j") if direction == "previous" else F.desc("__j"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = cells.unionByName(asks).withColumn("__hit", F.last("__hit", True).over(order)).where("__side = 1")
    hit = F.col("__hit")
    if tolerance is not None:
        gap = F.abs(number(F.col(dim), met, dim) - F.col("__hit.__x"))
        hit = F.when(gap <= tolerance * (1e6 if asked.is_time else 1.0), hit)
    out = met.withColumn("__hit", hit).select(*others, dim, *(F.col(f"__hit.{o}").alias(o) for o in outs))
    return source.with_df(out, dims=[*others, dim])


def as_of(source: Coverage, request: DataFrame, dim: str, direction: str = "previous", tolerance: float | None = None) -> Coverage:
    """The last source value at or before each requested one (``next``: the first at or after) for sources
    of any size: both are merged in order within the shared dimensions and the value is carried along.
    Missing source cells are passed over. Requests that share no dimension with the source have no key
    to split by: both are cut into ranges of ``dim``, and each range starts from the last value before it."""
    shared = [d for d in source.dims if d != dim and d in request.columns]
    keep = [c for c in request.columns if not c.startswith("__i_")]
    outs = list(source.outputs)
    left = source.df.select(*shared, dim, F.struct(F.col(dim).alias("at"), *outs).alias("__hit"), F.lit(0 if direction == "previous" else 1).alias("__side"), *(F.lit(None).cast(request.schema[c].dataType).alias(c) for c in keep if c not in shared and c != dim))
    for o in outs:
        left = left.where(F.col(f"__hit.{o}").isNotNull())
    right = request.select(*shared, dim, F.lit(None).cast(left.schema["__hit"].dataType).alias("__hit"), F.lit(1 if direction == "previous" else 0).alias("__side"), *(c for c in keep if c not in shared and c != dim))
    keys, merged = shared, left.unionByName(right)
    if not shared:
        keys, cut = ["__range"], range_column(source.df, dim)
        merged, left = merged.withColumn("__range", cut), left.withColumn("__range", cut)
    order = Window.partitionBy(*keys).orderBy(*((dim, "__side") if direction == "previous" else (F.desc(dim), F.desc("__side"))))
    merged = merged.withColumn("__found", F.last("__hit", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__side") == (1 if direction == "previous" else 0))
    if not shared:
        merged = _from_other_ranges(merged, left.where("__hit is not null"), direction)
    hit = F.col("__found")
    if tolerance is not None:
        gap = F.abs(number(F.col(dim), source.df, dim) - number(F.col("__found.at"), source.df, dim))
        hit = F.when(gap <= tolerance * (1e6 if isinstance(source.df.schema[dim].dataType, T.TimestampType) else 1.0), hit)
    out = merged.withColumn("__found", hit).select(*keep, *(F.col(f"__found.{o}").alias(o) for o in outs))
    return source.with_df(out, dims=keep)


def _from_other_ranges(rows: DataFrame, cells: DataFrame, direction: str) -> DataFrame:
    """``rows`` (__range, __found), where nothing was found in a row's own range taking the last (``next``: the first)
    __hit of ``cells`` in the ranges before (after) it. One row a range is carried along the ranges."""
    ends = cells.groupBy("__range").agg((F.max if direction == "previous" else F.min)("__hit").alias("__end"))
    ranges = rows.select("__range").distinct().join(ends, "__range", "full_outer")
    order = Window.orderBy("__range" if direction == "previous" else F.desc("__range"))
    far = F.last("__end", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(ranges.select("__range", far.alias("__far")), "__range", "left").withColumn("__found", F.coalesce("__found", "__far")).drop("__far", "__range")


def nearest_points(source: Coverage, request: DataFrame, dims: list[str], cell: float, reach: float, scales: dict[str, float] | None = None) -> Coverage:
    """The nearest scattered source point to each requested one, within ``reach`` (scaled Euclidean).

    Points are dealt into cells of ``cell`` (at least ``reach`` / 3 for a bounded number of them); each
    request looks into the cells that its reach touches, an equi-join on cell numbers. Equal distances
    go to the point that sorts first.
    """
    scale = {d: (scales or {}).get(d, 1.0) for d in dims}
    rings = max(1, math.ceil(reach / cell))
    at = lambda df, d: number(F.col(d), df, d) * scale[d]
    keep = [c for c in request.columns if not c.startswith("__i_")]
    req = request.select(*keep, *(F.floor(at(request, d) / cell).alias(f"__c_{d}") for d in dims))
    for d in dims:
        req = req.withColumn(f"__c_{d}", F.explode(F.sequence(F.col(f"__c_{d}") - rings, F.col(f"__c_{d}") + rings)))
    src = source.df.select(*(F.col(d).alias(f"__s_{d}") for d in dims), *source.outputs, *(F.floor(at(source.df, d) / cell).alias(f"__c_{d}") for d in dims))
    joined = req.join(src, [f"__c_{d}" for d in dims])
    dist = sum(F.pow((number(F.col(d), request, d) - number(F.col(f"__s_{d}"), src, f"__s_{d}")) * scale[d], F.lit(2.0)) for d in dims)
    near = joined.withColumn("__d", F.sqrt(dist)).where(F.col("__d") <= reach)
    best = near.groupBy(*keep).agg(F.min(F.struct("__d", *(f"__s_{d}" for d in dims), *source.outputs)).alias("__b"))
    out = request.select(*keep).distinct().join(best, keep, "left").select(*keep, *(F.col(f"__b.{o}").alias(o) for o in source.outputs))
    return source.with_df(out, dims=keep)


#: Points that a plan may hold as literals; more are a table and go through ``nearest_scattered``.
LISTED = 20_000


def nearest_listed(source: Coverage, request: DataFrame, stack: Stack, scales: dict[str, float] | None = None, tolerance: float | None = None) -> Coverage:
    """The nearest of a plan-time list of source points, over the dimensions that both have (scaled
    Euclidean; times in seconds). Equal distances go to the point listed first. The points are literals
    of the plan, so each request finds its point on its own and meets the source by an equi-join."""
    dims = [a.name for a in stack.axes if a.name in request.columns]
    if not dims:
        raise ValueError("the request has none of the source's stacked dimensions")
    unit = {a.name: 1e6 if a.is_time else 1.0 for a in stack.axes}
    values = lambda a: [tu.micros(v) / 1e6 if a.is_time else float(v) for v in a.coordinates]
    lists = {a.name: F.lit(values(a)) for a in stack.axes if a.name in dims}
    at = {d: number(F.col(d), request, d) / unit[d] for d in dims}

    def gap(i: Column) -> Column:
        return sum(F.pow((F.get(lists[d], i) - at[d]) * (scales or {}).get(d, 1.0), F.lit(2.0)) for d in dims)

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(stack.size - 1)), lambda i: F.struct(gap(i).alias("d"), i.alias("i"))))
    keep = [c for c in request.columns if not c.startswith("__i_")]
    hit = request.select(*keep, best.alias("__b"))
    if tolerance is not None:
        hit = hit.withColumn("__b", F.when(F.sqrt("__b.d") <= tolerance, F.col("__b")))
    keys = {a.name: F.get(F.lit([tu.micros(v) if a.is_time else float(v) for v in a.coordinates]), F.col("__b.i")) for a in stack.axes}
    hit = hit.select(*keep, *(k.alias(f"__k_{d}") for d, k in keys.items()))
    exact = lambda d: F.unix_micros(d) if isinstance(source.df.schema[d].dataType, T.TimestampType) else F.col(d)
    free = [d for d in source.dims if d not in keys and d not in keep]
    src = source.df.select(*(exact(d).alias(f"__k_{d}") for d in keys), *(d for d in source.dims if d not in keys), *source.outputs)
    joined = hit.join(src, [*(f"__k_{d}" for d in keys), *(d for d in source.dims if d not in keys and d in keep)], "left")
    return source.with_df(joined.select(*keep, *free, *source.outputs), dims=[*keep, *free])


def nearest_scattered(source: Coverage, request: DataFrame, stacked: list[str], scales: dict[str, float] | None = None, tolerance: float | None = None) -> Coverage:
    """The same for any number of points: they are dealt into cells, and requests without a point within reach look again
    with twice the reach until all have one (or nothing lies within ``tolerance``). Equal distances go to the point that
    sorts first."""
    keep = [c for c in request.columns if not c.startswith("__i_")]
    dims = [d for d in stacked if d in keep]
    if not dims:
        raise ValueError("the request has none of the source's stacked dimensions")
    unit = {d: (scales or {}).get(d, 1.0) * (1e-6 if isinstance(source.df.schema[d].dataType, T.TimestampType) else 1.0) for d in dims}
    rest = [d for d in stacked if d not in dims]
    points = source.df.select(*stacked, *(F.col(d).alias(f"__k_{d}") for d in stacked)).distinct().drop(*rest)
    cover = Coverage(points, tuple(dims), tuple(f"__k_{d}" for d in stacked))
    x = lambda df, d: number(F.col(d), df, d) * unit[d]
    ends = lambda df: df.agg(F.count("*").alias("n"), *(f(x(df, d)).alias(f"{i}{d}") for d in dims for i, f in (("lo", F.min), ("hi", F.max)))).head()
    own, asked = ends(points), ends(request)
    found, left = None, request.select(*keep).distinct()
    span = {d: max(own[f"hi{d}"], asked[f"hi{d}"]) - min(own[f"lo{d}"], asked[f"lo{d}"]) for d in dims} if own.n and asked.n else dict.fromkeys(dims, 0.0)
    whole = math.sqrt(sum(v * v for v in span.values())) or 1.0
    reach = max(max(span.values()) / max(1.0, own.n ** (1 / len(dims))), whole * 1e-6)
    while True:
        at = reach if tolerance is None else min(reach, tolerance)
        near = nearest_points(cover, left, dims, max(at, whole * 1e-9), at, unit)
        known = F.col(f"__k_{stacked[0]}").isNotNull()
        if at > whole or tolerance is not None and at >= tolerance or (left := near.df.where(~known).select(*keep)).isEmpty():
            found = near.df if found is None else found.unionByName(near.df)
            break
        found = near.df.where(known) if found is None else found.unionByName(near.df.where(known))
        reach *= 2
    free = [d for d in source.dims if d not in stacked and d not in keep]
    shared = [d for d in source.dims if d not in stacked and d in keep]
    src = source.df.select(*(F.col(d).alias(f"__k_{d}") for d in stacked), *shared, *free, *source.outputs)
    joined = request.select(*keep).join(found.distinct(), keep).join(src, [*(f"__k_{d}" for d in stacked), *shared], "left")
    return source.with_df(joined.select(*keep, *free, *source.outputs), dims=[*keep, *free])


def nearest_at_points(source: Coverage, request: DataFrame, axes: dict[str, UniformAxis], ties: str = "-infinity") -> Coverage:
    """Points over a gridded source: an index for each dimension, and one equi-join on all of them."""
    df, src = request, source.df
    for d, axis in axes.items():
        index = TIES[ties](axis_index(F.col(d), axis)).cast("long")
        df = df.withColumn(f"__k_{d}", F.when((index >= 0) & (index < axis.size), index))
        src = src.withColumn(f"__k_{d}", whole_index(F.col(d), axis))
    keep = [c for c in request.columns if not c.startswith("__i_")]
    others = [d for d in source.dims if d not in axes]
    shared, free = [d for d in others if d in keep], [d for d in others if d not in keep]
    out = df.join(src.drop(*axes), [*(f"__k_{d}" for d in axes), *shared], "left").select(*keep, *free, *source.outputs)
    return source.with_df(out, dims=[*keep, *free])


def linear(source: Coverage, request: DataFrame, dim: str, axis: UniformAxis, extrapolate: bool = False, first_pruned: int | None = None) -> Coverage:
    """Linear along one uniform dimension: both neighbours by index, and a weighted sum.

    The bracket of a value is the interval that ends at it, so a missing left neighbour makes an exact hit
    missing too; the axis's first cell (or the first that the whole request needs, ``first_pruned``) stands
    for itself. Outside the axis values are missing, or continued from the end interval.
    """
    n, low = axis.size, first_pruned or 0
    if n - low < 2:
        return nearest_uniform(source, request, dim, axis)
    place = axis_index(F.col(dim), axis)
    near = F.rint(place)
    place = F.when(F.abs(place - near) < 1e-9, near).otherwise(place)
    lo = F.greatest(F.ceil(place) - 1, F.lit(low)).cast("long")
    lo = F.least(lo, F.lit(n - 2))
    inside = (place >= low) & (place <= n - 1)
    key = lo if extrapolate else F.when(inside, lo)
    keep = [c for c in request.columns if not c.startswith("__i_")]
    shared = [d for d in source.dims if d != dim and d in keep]
    free = [d for d in source.dims if d != dim and d not in keep]
    outs = list(source.outputs)
    src = source.df.select(*shared, *free, whole_index(F.col(dim), axis).alias("__k"), *outs)
    pair = src.withColumn("__lo", F.explode(F.array(F.col("__k"), F.col("__k") - 1)))
    # each cell serves two brackets: one shuffle of the source brings both ends together
    ends = pair.groupBy("__lo", *shared, *free).agg(*(F.max(F.when(F.col("__k") == F.col("__lo") + s, F.col(o))).alias(f"__{o}_{s}") for o in outs for s in (0, 1)), F.count("*").alias("__n")).where("__n = 2")
    joined = request.select(*keep, key.alias("__lo"), (place - lo).alias("__w")).join(ends, ["__lo", *shared], "left")
    value = lambda o: F.col(f"__{o}_0") * (1 - F.col("__w")) + F.col(f"__{o}_1") * F.col("__w")
    out = joined.select(*keep, *free, *(value(o).alias(o) for o in outs))
    for d in free:
        out = out.where(F.col(d).isNotNull())
    return source.with_df(out, dims=[*keep, *free])


def bilinear(source: Coverage, request: DataFrame, lat: str, lon: str, lat_axis: UniformAxis, lon_axis: UniformAxis, first: tuple[int, int] = (0, 0)) -> Coverage:
    """Two dimensions at once: four neighbours by index in one join, weights multiplied, missing if any is."""
    keep = [c for c in request.columns if not c.startswith("__i_")]
    free = [d for d in source.dims if d not in (lat, lon) and d not in keep]
    shared = [d for d in source.dims if d not in (lat, lon) and d in keep]
    df = request.select(*keep)
    for d, axis, low in ((lat, lat_axis, first[0]), (lon, lon_axis, first[1])):
        place = axis_index(F.col(d), axis)
        near = F.rint(place)
        place = F.when(F.abs(place - near) < 1e-9, near).otherwise(place)
        lo = F.least(F.greatest(F.ceil(place) - 1, F.lit(low)), F.lit(axis.size - 2)).cast("long")
        df = df.withColumn(f"__lo_{d}", F.when((place >= low) & (place <= axis.size - 1), lo)).withColumn(f"__w_{d}", place - lo)
    corners = F.explode(F.expr("array(struct(0 as a, 0 as b), struct(0 as a, 1 as b), struct(1 as a, 0 as b), struct(1 as a, 1 as b))"))
    df = df.withColumn("__c", corners)
    weight = lambda d, bit: F.when(F.col(f"__c.{bit}") == 1, F.col(f"__w_{d}")).otherwise(1 - F.col(f"__w_{d}"))
    df = df.select(*keep, (F.col(f"__lo_{lat}") + F.col("__c.a")).alias("__a"), (F.col(f"__lo_{lon}") + F.col("__c.b")).alias("__b"), (weight(lat, "a") * weight(lon, "b")).alias("__w"))
    src = source.df.select(*shared, *free, whole_index(F.col(lat), lat_axis).alias("__a"), whole_index(F.col(lon), lon_axis).alias("__b"), *source.outputs)
    joined = df.join(src, ["__a", "__b", *shared], "left")
    outs = [F.when(F.count(o) == 4, F.sum(F.col(o) * F.col("__w"))).alias(o) for o in source.outputs]
    out = joined.groupBy(*keep, *free).agg(*outs)
    for d in free:
        out = out.where(F.col(d).isNotNull())
    return source.with_df(out, dims=[*keep, *free])


def first_needed(request: DataFrame, dim: str, axis: UniformAxis) -> int:
    """The first source index that any requested value needs (one small aggregate)."""
    low = request.agg(F.min(F.floor(axis_index(F.col(dim), axis) + 1e-9))).head()[0]
    return max(0, min(axis.size - 1, int(low))) if low is not None else 0


def _around(c: Coverage, dim: str) -> DataFrame:
    """The cells with, for each output o, the last known one at or before (__a_o) and the first known one at or after
    (__b_o), as structs of x (the dimension as a number) and v. Either is carried along an order of its own, as Spark
    goes over the rest of a group anew for each row of a frame that ends with the group."""
    others = [d for d in c.dims if d != dim]
    df = c.df if others else c.df.withColumn("__range", range_column(c.df, dim))
    keys = others or ["__range"]
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(dim), F.desc(dim)))
    x = number(F.col(dim), c.df, dim)
    known = {o: F.when(F.col(o).isNotNull(), F.struct(x.alias("x"), F.col(o).alias("v"))) for o in c.outputs}
    out = df
    for o, k in known.items():
        out = out.withColumns({f"__a_{o}": F.last(k, True).over(up), f"__b_{o}": F.last(k, True).over(down)})
    if others:
        return out
    for o, k in known.items():
        cells = df.select("__range", k.alias("__hit")).where("__hit is not null")
        for side, direction in (("a", "previous"), ("b", "next")):
            held = out.withColumnRenamed(f"__{side}_{o}", "__found").withColumn("__keep", F.col("__range"))
            out = _from_other_ranges(held, cells, direction).withColumnsRenamed({"__found": f"__{side}_{o}", "__keep": "__range"})
    return out


def fill_missing(c: Coverage, dim: str) -> Coverage:
    """Fill missing cells along a dimension from the nearest known ones on both sides, linearly; ends stay missing."""
    x = number(F.col(dim), c.df, dim)

    def filled(o: str) -> Column:
        v, a, b = F.col(o), F.col(f"__a_{o}"), F.col(f"__b_{o}")
        return F.when(v.isNotNull(), v).otherwise(a["v"] + (b["v"] - a["v"]) * F.try_divide(x - a["x"], b["x"] - a["x"]))

    return c.with_df(_around(c, dim).select(*c.dims, *(filled(o).alias(o) for o in c.outputs)))


def fill_carried(c: Coverage, dim: str, reach: float) -> Coverage:
    """Fill missing cells along a dimension from the last known cell within ``reach`` (seconds for time), or else from
    the next one within it."""
    x = number(F.col(dim), c.df, dim)
    far = reach * (1e6 if isinstance(c.df.schema[dim].dataType, T.TimestampType) else 1.0)

    def filled(o: str) -> Column:
        a, b = F.col(f"__a_{o}"), F.col(f"__b_{o}")
        return F.coalesce(F.when(x - a["x"] <= far, a["v"]), F.when(b["x"] - x <= far, b["v"]))

    return c.with_df(_around(c, dim).select(*c.dims, *(filled(o).alias(o) for o in c.outputs)))


def carried_cells(c: Coverage, dim: str, step: str, reach: float, ends: DataFrame) -> Coverage:
    """The known cells of a time axis of step "n,U" (days and shorter) and the missing ones that ``fill_carried`` would fill
    between the times lo and hi of ``ends`` (one row): each known cell is repeated over its neighbours within ``reach``
    seconds. Only known cells are sorted, so the work follows them and not the length of the axis."""
    if len(c.outputs) != 1:
        raise ValueError("one output at a time, as each has known cells of its own")
    width, others = tu.micros(tu.step(step)), [d for d in c.dims if d != dim]
    most, none = (F.lit(n).cast("long") for n in (int(reach * 1e6 // width), 0))
    steps = lambda a, b: F.call_function("div", F.unix_micros(b) - F.unix_micros(a), F.lit(width).cast("long"))
    order = Window.partitionBy(*others).orderBy(dim)
    known = c.df.where(F.col(c.outputs[0]).isNotNull())
    known = known.withColumns({"__p": F.lag(dim).over(order), "__n": F.lead(dim).over(order)}).crossJoin(F.broadcast(ends))
    # cells in reach of the one before are that one's
    back = F.greatest(none, F.least(most, F.coalesce(steps("__p", dim) - 1 - most, steps("lo", dim))))
    forth = F.least(most, F.coalesce(steps(dim, "__n") - 1, steps(dim, "hi")))
    spread = known.select(*others, F.col(dim).alias("__at"), *c.outputs, F.explode(F.sequence(-back, forth)).alias("__i"))
    return c.with_df(spread.select(*others, F.timestamp_micros(F.unix_micros("__at") + F.col("__i") * width).alias(dim), *c.outputs), dims=[*others, dim])


QUANTILES = {"med": 0.5, "q1": 0.25, "q3": 0.75}


def area_resample(source: Coverage, method: str, axes: dict[str, tuple[UniformAxis, UniformAxis]]) -> Coverage:
    """Resample to coarser uniform axes: each source cell goes to the target cell that holds its centre.
    ``axes`` is {dim: (source axis, target axis)}. Modes that tie take the smallest value."""
    aggregates: dict[str, Callable[[Column], Column]] = {
        "average": F.avg,
        "mode": lambda v: F.mode(v, deterministic=True),
        "max": F.max,
        "min": F.min,
        "sum": F.sum,
    }
    if method == "gauss":
        return _gauss(source, axes)
    df = source.df
    for d, (_, target) in axes.items():
        index = F.rint(axis_index(F.col(d), target)).cast("long")
        df = df.withColumn(f"__t_{d}", F.when((index >= 0) & (index < target.size), index)).where(F.col(f"__t_{d}").isNotNull())
    others = [d for d in source.dims if d not in axes]
    keys = [*others, *(f"__t_{d}" for d in axes)]
    if method in QUANTILES:
        from lodegrid.operators.reduce import exact_quantile

        out = exact_quantile(df, keys, list(source.outputs), QUANTILES[method])
    else:
        out = df.groupBy(*keys).agg(*(aggregates[method](F.col(o)).alias(o) for o in source.outputs))
    values = [_value_at(F.col(f"__t_{d}"), t).alias(d) for d, (_, t) in axes.items()]
    return source.with_df(out.select(*others, *values, *source.outputs), dims=[*others, *axes])


def _value_at(i: Column, axis: UniformAxis) -> Column:
    if axis.is_time:
        return F.timestamp_micros(F.lit(tu.micros(axis.values[0])) + i * F.lit(tu.micros(axis.step)))
    return F.lit(float(axis.values[0])) + i * F.lit(float(axis.step))


def _gauss(source: Coverage, axes: dict[str, tuple[UniformAxis, UniformAxis]]) -> Coverage:
    """Means weighted by a Gaussian of half a target cell's width, over the target cell and its neighbours."""
    df, weight = source.df, F.lit(1.0)
    for d, (_, target) in axes.items():
        place = axis_index(F.col(d), target)
        df = df.withColumn(f"__t_{d}", F.explode(F.sequence(F.rint(place).cast("long") - 1, F.rint(place).cast("long") + 1))).where((F.col(f"__t_{d}") >= 0) & (F.col(f"__t_{d}") < target.size))
        weight = weight * F.exp(-2 * F.pow(place - F.col(f"__t_{d}"), F.lit(2.0)))
    others = [d for d in source.dims if d not in axes]
    outs = [F.try_divide(F.sum(F.col(o) * weight), F.sum(F.when(F.col(o).isNotNull(), weight))).alias(o) for o in source.outputs]
    out = df.groupBy(*others, *(f"__t_{d}" for d in axes)).agg(*outs)
    values = [_value_at(F.col(f"__t_{d}"), t).alias(d) for d, (_, t) in axes.items()]
    return source.with_df(out.select(*others, *values, *source.outputs), dims=[*others, *axes])


def spline_coefficients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline through (x, y)."""
    n = len(x)
    h = np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
        b[i] = (y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1]
    if n > 3:
        a[0, :3] = -h[1], h[0] + h[1], -h[0]
        a[-1, -3:] = -h[-1], h[-2] + h[-1], -h[-2]
    else:
        a[0, 0] = a[-1, -1] = 1.0
        if n == 3:  # a parabola: one second derivative throughout
            a[0, :2], a[-1, -2:] = (1.0, -1.0), (1.0, -1.0)
    return np.linalg.solve(a, b)


def polynomial(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int, even: str = "parabola") -> np.ndarray:
    """Interpolation of a degree; NaN outside. Cubic splines are not-a-knot; degree 2 takes the parabola through the
    three nearest points, or with ``even="spline"``, as every other degree, the interpolating spline."""
    good = ~np.isnan(y)
    x, y = x[good], y[good]
    if len(x) <= degree:
        return np.full(len(at), np.nan)
    inside = (at >= x[0]) & (at <= x[-1])
    i = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    if degree == 3:
        m = spline_coefficients(x, y)
        h = x[i + 1] - x[i]
        a, b = (x[i + 1] - at) / h, (at - x[i]) / h
        out = a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h**2 / 6
    elif degree == 2 and even == "parabola":
        j = np.clip(np.where(at - x[i] > x[i + 1] - at, i, i - 1), 0, len(x) - 3)
        p, q, r = x[j], x[j + 1], x[j + 2]
        out = y[j] * (at - q) * (at - r) / ((p - q) * (p - r)) + y[j + 1] * (at - p) * (at - r) / ((q - p) * (q - r)) + y[j + 2] * (at - p) * (at - q) / ((r - p) * (r - q))
    else:
        knots = spline_knots(x, degree)
        out = basis(np.clip(at, x[0], x[-1]), knots, degree) @ np.linalg.solve(basis(x, knots, degree), y)
    return np.where(inside, out, np.nan)


def spline_knots(x: np.ndarray, degree: int) -> np.ndarray:
    """Knots of the interpolating spline: the points for odd degrees, their middles for even ones, without those next
    to the ends, so that there are as many coefficients as points."""
    half = degree // 2
    inner = x[half + 1 : len(x) - half - 1] if degree % 2 else ((x[1:] + x[:-1]) / 2)[half : len(x) - 1 - half]
    return np.concatenate([[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)])


def basis(at: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """The values of all B-splines of a degree at each point (rows), by their recurrence."""
    n = len(knots) - degree - 1
    cell = np.clip(np.searchsorted(knots, at, side="right") - 1, degree, n - 1)
    out = (cell[:, None] == np.arange(len(knots) - 1)[None]).astype(float)
    for k in range(1, degree + 1):
        left, right = knots[:-k], knots[k:]
        with np.errstate(divide="ignore", invalid="ignore"):
            ramp = np.where(right > left, (at[:, None] - left[None]) / (right - left)[None], 0.0)
        out = ramp[:, :-1] * out[:, : len(knots) - 1 - k] + np.where(right > left, 1 - ramp, 0.0)[:, 1:] * out[:, 1 : len(knots) - k]
    return out


def spline(source: Coverage, request: Axis, dim: str, degree: int = 3, even: str = "parabola") -> Coverage:
    """Polynomial interpolation along one dimension to a plan-time axis, a line at a time in pandas
    workers; a line is one combination of the other dimensions."""
    others = [d for d in source.dims if d != dim]
    outs = list(source.outputs)
    at = np.array([tu.micros(v) if request.is_time else float(v) for v in request.coordinates], float)
    stamps = pd.to_datetime(at.astype("int64"), unit="us") if request.is_time else at
    fields = {f.name: f for f in source.df.schema}
    schema = T.StructType([*(fields[d] for d in others), fields[dim], *(T.StructField(o, T.DoubleType()) for o in outs)])

    def run(line: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values(dim)
        x = line[dim].astype("datetime64[us]").astype("int64").to_numpy(float) if request.is_time else line[dim].to_numpy(float)
        data = {d: [line[d].iloc[0]] * len(at) for d in others} | {dim: stamps}
        return pd.DataFrame(data | {o: polynomial(x, line[o].to_numpy(float), at, degree, even) for o in outs})[[*others, dim, *outs]]

    made = source.with_df(source.df.groupBy(*others).applyInPandas(run, schema), dims=[*others, dim])
    return made.mapped(lambda v: F.when(F.isnan(v), None).otherwise(v))


def lanczos(source: Coverage, request: DataFrame, dim: str, axis: UniformAxis, lobes: int = 3) -> Coverage:
    """Windowed sinc along one uniform dimension: the ``lobes`` cells on either side of each requested value, weighted
    and normalised over the known ones. Outside the axis, or where its nearest cell is missing, the result is missing."""
    keep = [c for c in request.columns if not c.startswith("__i_")]
    shared = [d for d in source.dims if d != dim and d in keep]
    free = [d for d in source.dims if d != dim and d not in keep]
    place = axis_index(F.col(dim), axis)
    inside = (place >= -1e-9) & (place <= axis.size - 1 + 1e-9)
    first = F.floor(place + 1e-9).cast("long") - (lobes - 1)
    asks = request.select(*keep, place.alias("__p"), F.when(inside, first).alias("__f"))
    asks = asks.withColumn("__k", F.explode(F.when(F.col("__f").isNotNull(), F.sequence(F.col("__f"), F.col("__f") + (2 * lobes - 1))).otherwise(F.array(F.lit(-1).cast("long")))))
    d = F.col("__p") - F.col("__k")
    sinc = lambda t: F.when(F.abs(t) < 1e-9, 1.0).otherwise(F.sin(F.pi() * t) / (F.pi() * t))
    asks = asks.withColumn("__w", F.when(F.abs(d) < lobes, sinc(d) * sinc(d / lobes)).otherwise(0.0)).withColumn("__near", F.abs(d) <= 0.5 + 1e-9)
    src = source.df.select(*shared, *free, whole_index(F.col(dim), axis).alias("__k"), *source.outputs)
    joined = asks.join(src, ["__k", *shared], "left")
    value = lambda o: F.when(F.bool_or(F.col("__near") & F.col(o).isNotNull()), F.try_divide(F.sum(F.col(o) * F.col("__w")), F.sum(F.when(F.col(o).isNotNull(), F.col("__w")))))
    out = joined.groupBy(*keep, *free).agg(*(value(o).alias(o) for o in source.outputs))
    for f in free:
        out = out.where(F.col(f).isNotNull())
    return source.with_df(out, dims=[*keep, *free])


def strided(source: Coverage, dim: str, axis: UniformAxis, wanted_step: float) -> Coverage:
    """A preview: every n-th cell, n the ratio of the steps."""
    width = abs(tu.micros(axis.step)) / 1e6 if axis.is_time else abs(float(axis.step))
    n = max(1, round(abs(wanted_step) / width))
    return source.with_df(source.df.where(F.pmod(whole_index(F.col(dim), axis), F.lit(n)) == 0))
