"""Operators that change which coordinates are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.functions import calendar
from lodegrid.functions import timeunits as tu
from lodegrid.plans.coordinates import literal
from lodegrid.plans.coverage import Coverage


def _shift(col, delta):
    d = tu.step(delta)
    if isinstance(d, float):
        return col + d
    if tu.nominal(d):
        months = int(d.astype(int)) * (12 if tu.unit(d) == "Y" else 1)
        return col + F.make_interval(F.lit(0), F.lit(months))
    return F.timestamp_micros(F.unix_micros(col) + F.lit(tu.micros(d)))


def expand(source: Coverage, request: DataFrame, dim: str, start: object, stop: object, bounds_only: bool = False, bucket: float | None = None) -> Coverage:
    """For each requested value the source cells in [value + start, value + stop], with multiplicity: a cell
    comes once for each request that reaches it, keyed by "request_<dim>". ``bounds_only`` takes the range
    from the first request's start to the last one's stop, each cell once.

    ``bucket`` (a width in the dimension's unit, seconds for time) turns the range join into an equi-join
    on the buckets that a range touches; it defaults to the range's own width.
    """
    if bounds_only:
        ends = request.agg(F.min(dim).alias("lo"), F.max(dim).alias("hi")).head()
        if ends.lo is None:
            raise ValueError("the request is empty")
        lo, hi = F.lit(ends.lo), F.lit(ends.hi)
        return source.with_df(source.df.where((F.col(dim) >= _shift(lo, start)) & (F.col(dim) <= _shift(hi, stop))))
    from lodegrid.operators.interpolate import number

    key = f"request_{dim}"
    req = request.select(F.col(dim).alias(key)).withColumns({"__lo": _shift(F.col(key), start), "__hi": _shift(F.col(key), stop)})
    unit = 1e6 if dict(source.df.dtypes)[dim] == "timestamp" else 1.0
    a, b = tu.step(start), tu.step(stop)
    span = (tu.micros(b) - tu.micros(a)) / 1e6 if not isinstance(a, float) else b - a
    width = (bucket or max(span, 1e-9)) * unit
    at = lambda c, df: F.floor(number(F.col(c), df, c) / width)
    req = req.withColumn("__b", F.explode(F.sequence(at("__lo", req), at("__hi", req))))
    src = source.df.withColumn("__b", at(dim, source.df))
    met = src.join(req, "__b").where((F.col(dim) >= F.col("__lo")) & (F.col(dim) <= F.col("__hi")))
    return source.with_df(met.select(key, *source.dims, *source.outputs), dims=[key, *source.dims])


def select(source: Coverage, dim: str, selection: list) -> Coverage:
    """One value (or two equal ones): that coordinate; two: bounds."""
    lo, hi = (tu.value(v) for v in (selection * 2)[:2]) if len(selection) == 1 else (tu.value(v) for v in selection[:2])
    return source.with_df(source.df.where((F.col(dim) >= literal(lo)) & (F.col(dim) <= literal(hi))))


def year_substitute(request: DataFrame, year: int, dim: str = "time") -> DataFrame:
    """The request with each time moved to ``year``."""
    return request.withColumn(dim, calendar.to_year(F.col(dim), year))


def substitute_back(source: Coverage, request: DataFrame, rewritten: DataFrame, dim: str) -> Coverage:
    """Results at the rewritten coordinates, labelled with the requested ones; both tables have one order
    by an index column named for the dimension."""
    from lodegrid.plans.coordinates import index_column

    i = index_column(dim)
    pairs = request.select(i, F.col(dim).alias("__own")).join(rewritten.select(i, dim), i).select("__own", dim)
    df = source.df.join(pairs, dim).drop(dim).withColumnRenamed("__own", dim)
    return source.with_df(df.select(*source.dims, *source.outputs))


def transform_time(source: Coverage, unit: str, dim: str = "time") -> Coverage:
    """Time replaced by one of its calendar parts."""
    return source.with_df(source.df.withColumn(dim, calendar.part(F.col(dim), unit)))
