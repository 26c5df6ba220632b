"""Projections over coverages: alignment of inputs, arithmetic, masks, combination of outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.functions import expressions, units
from lodegrid.operators.interpolate import range_column
from lodegrid.plans.coverage import Coverage
from lodegrid.plans.settings import settings

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": lambda a, b: a == b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "!=": lambda a, b: a != b,
}


def align(inputs: dict[str, Coverage], how: str = "full_outer") -> Coverage:
    """One coverage with an output for each input (single-output ones): a key join on shared dimensions,
    a product where none is shared. Keys meet exactly; uniform axes carry one expression on both sides."""
    items = [(name, c.select(c.outputs[0]) if c.outputs != ("value",) else c) for name, c in inputs.items()]
    name, first = items[0]
    df, dims = first.df.withColumnRenamed("value", name), list(first.dims)
    for name, c in items[1:]:
        right = c.df.withColumnRenamed("value", name)
        shared = [d for d in dims if d in c.dims]
        df = df.join(right, shared, how) if shared else df.crossJoin(right)
        dims += [d for d in c.dims if d not in dims]
    names = [n for n, _ in items]
    return first.with_df(df.select(*dims, *names), dims=dims, outputs=names)


def arithmetic(eqn: str, inputs: dict[str, Coverage], params: dict[str, object] | None = None, how: str = "full_outer") -> Coverage:
    """``eqn`` over named inputs, after ``params`` are put in for "{name}". Where one table feeds several
    inputs, its keys meet in one join that Spark resolves by reuse of the exchange."""
    text = eqn.format(**params) if params else eqn
    used = expressions.names(text)
    if missing := used - inputs.keys():
        raise expressions.ExpressionError(f"no input for {sorted(missing)}")
    if len(inputs) == 1:
        ((name, only),) = inputs.items()
        return only.mapped(lambda v: expressions.column(text, {name: v}))
    wide = align(inputs, how)
    value = expressions.column(text, {n: F.col(n) for n in wide.outputs})
    return wide.with_df(wide.df.select(*wide.dims, value.alias("value")), outputs=["value"])


def binary(op: str, a: Coverage, b: Coverage | float) -> Coverage:
    """Elementwise arithmetic and comparison with units (unless the setting ENABLE_UNITS is off); a number has none."""
    if not settings["ENABLE_UNITS"]:
        a = a.with_attrs(units=None)
        b = b.with_attrs(units=None) if isinstance(b, Coverage) else b
    unit, scale = units.result(op, a.units, b.units if isinstance(b, Coverage) else (a.units if op not in "*/" else None))
    if not isinstance(b, Coverage):
        other = {"b": F.lit(float(b))}
        out = a.mapped(lambda v: expressions.column(f"a {op} b", {"a": v} | other))
    else:
        out = arithmetic(f"a {op} (b * {scale!r})", {"a": a, "b": b}, how="inner")
    return Coverage(out.df, out.dims, out.outputs, {k: v for k, v in a.attrs.items() if k != "units"} | ({"units": unit} if unit else {}))


def convert(c: Coverage, unit: str) -> Coverage:
    """To another unit, by a factor."""
    if c.units is None:
        raise units.UnitError("data without units cannot be converted")
    k = units.factor(c.units, unit)
    return c.mapped(lambda v: v * k).with_attrs(units=unit)


def to_base_units(c: Coverage) -> Coverage:
    u = units.parse(c.units or "dimensionless")
    return c.mapped(lambda v: v * u.factor).with_attrs(units=str(units.Unit(1.0, u.dims)))


def mask(source: Coverage, by: Coverage, masked_val: float | None = None, bool_val: float = 1.0, bool_op: str = "==") -> Coverage:
    """Source cells where ``mask op bool_val`` become ``masked_val`` (missing by default). A missing mask
    compares false. The mask is spread over dimensions that only the source has; if it has one that the
    source lacks, nothing happens."""
    if bool_op not in COMPARE or bool_op == "!=":
        raise ValueError(f"bool_op must be one of == < <= > >=, not {bool_op!r}")
    if not set(by.dims) <= set(source.dims):
        return source
    flag = by.df.select(*by.dims, F.col(by.outputs[0]).alias("__mask"))
    df = source.df.join(flag, list(by.dims), "left") if by.dims else source.df.crossJoin(flag)
    hit = F.coalesce(COMPARE[bool_op](F.col("__mask"), F.lit(float(bool_val))), F.lit(False))
    value = F.lit(masked_val).cast("double")
    return source.with_df(df.select(*source.dims, *(F.when(hit, value).otherwise(F.col(o)).alias(o) for o in source.outputs)))


def mask_by_self(source: Coverage, masked_val: float | None = None, bool_val: float = 1.0, bool_op: str = "==", mask_output: str | None = None) -> Coverage:
    """The same where the mask is an output of the source's own table: a projection, no join."""
    by = F.col(mask_output or source.outputs[0])
    hit = F.coalesce(COMPARE[bool_op](by, F.lit(float(bool_val))), F.lit(False))
    value = F.lit(masked_val).cast("double")
    return source.mapped(lambda v: F.when(hit, value).otherwise(v))


def combine(inputs: dict[str, Coverage], check: bool = True) -> Coverage:
    """Inputs as outputs of one coverage; their keys must be equal (checked by anti-joins unless told not to)."""
    first = next(iter(inputs.values()))
    for name, c in inputs.items():
        if set(c.dims) != set(first.dims):
            raise ValueError(f"input {name!r} has dimensions {c.dims}, not {first.dims}")
        if check and c is not first:
            keys = list(first.dims)
            if not first.df.join(c.df, keys, "left_anti").isEmpty() or not c.df.join(first.df, keys, "left_anti").isEmpty():
                raise ValueError(f"the coordinates of input {name!r} differ from those of the first")
    return align(inputs, "inner")


def custom(inputs: dict[str, Coverage], f: Callable[[pd.DataFrame], pd.Series]) -> Coverage:
    """A user's function over aligned inputs, in Arrow batches: a frame of dimensions and inputs to one series."""
    wide = align(inputs)
    schema = T.StructType([*(wide.df.schema[d] for d in wide.dims), T.StructField("value", T.DoubleType())])
    dims = list(wide.dims)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[dims].assign(value=f(frame).astype(float))

    return wide.with_df(wide.df.mapInPandas(run, schema), outputs=["value"])


def cumulative(c: Coverage, dim: str) -> Coverage:
    """Running sum along a dimension within the others; missing cells add nothing and stay missing.

    A source of one dimension has no keys to split by: it is cut into ranges of the dimension, each is summed in
    itself, and the sums of the ranges before it (one row a range) are added."""
    from pyspark.sql import Window

    others = [d for d in c.dims if d != dim]
    if others:
        order = Window.partitionBy(*others).orderBy(dim).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return c.mapped(lambda v: F.when(v.isNotNull(), F.sum(v).over(order)))
    ranges = c.df.withColumn("__range", range_column(c.df, dim))
    within = Window.partitionBy("__range").orderBy(dim).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("__range").agg(*(F.sum(o).alias(f"__t_{o}") for o in c.outputs))
    totals = totals.select("__range", *(F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0.0)).alias(f"__b_{o}") for o in c.outputs))
    summed = ranges.select(dim, "__range", *(F.when(F.col(o).isNotNull(), F.sum(o).over(within)).alias(o) for o in c.outputs))
    return c.with_df(summed.join(totals, "__range").select(dim, *((F.col(o) + F.col(f"__b_{o}")).alias(o) for o in c.outputs)))


def index_grid(frame: DataFrame, dims: list[str], sizes: list[int]) -> Coverage:
    """0 to size-1 in row-major order over a request, from its index columns."""
    from lodegrid.plans.coordinates import index_column

    at = F.lit(0)
    for d, n in zip(dims, sizes, strict=True):
        at = at * n + F.col(index_column(d))
    return Coverage(frame.select(*dims, at.cast("double").alias("value")), tuple(dims))


def coordinate_data(frame: DataFrame, dims: list[str], name: str) -> Coverage:
    """The values of a dimension as data; times are seconds since the epoch."""
    if name not in dims:
        raise ValueError(f"the request has no dimension {name!r}")
    v = F.col(name)
    v = F.unix_micros(v) / 1e6 if isinstance(frame.schema[name].dataType, T.TimestampType) else v
    return Coverage(frame.select(*dims, v.cast("double").alias("value")), tuple(dims))


def sine_waves(frame: DataFrame, dims: list[str]) -> Coverage:
    """The product over dimensions of sin(pi x / 90), times in whole hours since the epoch."""
    out = F.lit(1.0)
    for d in dims:
        v = F.col(d)
        if isinstance(frame.schema[d].dataType, T.TimestampType):
            v = F.floor(F.unix_micros(v) / F.lit(3_600_000_000))
        out = out * F.sin(F.pi() * v / 90)
    return Coverage(frame.select(*dims, out.alias("value")), tuple(dims))
