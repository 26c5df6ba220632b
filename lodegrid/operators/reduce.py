"""Reductions: over dimensions, calendar groups, time buckets and circular day-of-year windows.

All but the user's own functions are Spark aggregates, so they combine partially before the shuffle and
keep their state in mergeable moments. Exact medians and percentiles are selected in two passes: a
histogram of each group tells the cell in which the rank lies, and only that cell's values are counted
one by one. Missing cells are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.functions import calendar
from lodegrid.functions import timeunits as tu
from lodegrid.plans.coverage import Coverage

INF = float("inf")


def finite(v: Column) -> Column:
    return F.abs(v) < INF


def _truth(v: Column) -> Column:
    return F.coalesce(v, F.lit(float("nan"))) != 0  # a missing cell is not zero


#: Aggregates by name. Sums of nothing are 0, products 1; counts of reductions are of finite cells.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "min": F.min,
    "max": F.max,
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)),
    "count": lambda v: F.count(F.when(finite(v), 1)).cast("double"),
    "mean": F.avg,
    "var": F.var_pop,
    "variance": F.var_pop,
    "std": F.stddev_pop,
    "skew": lambda v: _guard(v, F.skewness(v)),
    "kurtosis": lambda v: _guard(v, F.kurtosis(v)),
    "median": F.median,
    "prod": lambda v: F.coalesce(F.product(v), F.lit(1.0)),
    "all": lambda v: F.bool_and(_truth(v)).cast("double"),
    "any": lambda v: F.bool_or(_truth(v)).cast("double"),
}


def _guard(v: Column, moment: Column) -> Column:
    """Missing for constant groups, whose higher moments have no value."""
    return F.when(F.min(v) == F.max(v), None).otherwise(F.when(F.isnan(moment), None).otherwise(moment))


def aggregate(name: str, percentile: float | None = None) -> Callable[[Column], Column]:
    if name == "percentile":
        return lambda v: F.percentile(v, (50.0 if percentile is None else percentile) / 100)
    if name not in AGGREGATES:
        raise ValueError(f"unknown reduction {name!r}; known are {sorted(AGGREGATES)} and percentile")
    return AGGREGATES[name]


def histogram_cell(v: Column) -> Column:
    """A whole number that grows with v, about a 64th of a power of two wide: the same for equal values, and of a
    bounded number whatever the data."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    place = power * 64 + F.floor(size / F.pow(F.lit(2.0), power) * 64) - 64 + 1100 * 64
    return F.when(v == 0, 0).when(size == INF, F.signum(v) * 1_000_000).otherwise(F.signum(v) * place).cast("long")


def exact_quantile(df: DataFrame, keys: list[str], outputs: list[str], share: float) -> DataFrame:
    """(keys, outputs): the exact quantile of each output within each group, linear between the two ranks.

    Both aggregates combine partially, so a group of any size is at most its cells, and then the distinct values of one
    or two of them, in the tasks that follow."""
    found = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for o in outputs:
        rows = df.select(*keys, F.col(o).alias("v")).where("v is not null").withColumn("cell", histogram_cell(F.col("v")))
        by = Window.partitionBy(*keys)
        upto = by.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = rows.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
        cells = cells.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "rank": F.lit(float(share)) * (F.sum("n").over(by) - 1)})
        holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))  # noqa: B023, E731
        cells = cells.where(holds(F.floor("rank")) | holds(F.ceil("rank"))).select(*keys, "cell", "before", "rank")
        values = rows.join(cells, [*keys, "cell"]).groupBy(*keys, "cell", "before", "rank", "v").agg(F.count("*").alias("n"))
        within = Window.partitionBy(*keys, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        values = values.withColumn("before", F.col("before") + F.sum("n").over(within) - F.col("n"))
        low, high = (F.max(F.when(holds(r), F.col("v"))) for r in (F.floor("rank"), F.ceil("rank")))
        part = F.max("rank") - F.floor(F.max("rank"))
        one = values.groupBy(*keys).agg(F.when(low == high, low).otherwise(low + (high - low) * part).alias(o))
        found = found.join(one, keys, "left") if keys else found.crossJoin(one)  # one row
    return found


def _aggregated(df: DataFrame, keys: list[str], fn: str, outputs: list[str], percentile: float | None = None) -> DataFrame:
    if fn in ("median", "percentile"):
        return exact_quantile(df, keys, list(outputs), 0.5 if fn == "median" or percentile is None else percentile / 100)
    f = aggregate(fn, percentile)
    return df.groupBy(*keys).agg(*(f(F.col(o)).alias(o) for o in outputs))


def reduce(c: Coverage, fn: str, dims: list[str] | None = None, percentile: float | None = None) -> Coverage:
    """Reduce over ``dims`` (all if none are given; unknown ones are ignored)."""
    gone = [d for d in c.dims if dims is None or d in dims]
    left = [d for d in c.dims if d not in gone]
    return c.with_df(_aggregated(c.df, left, fn, c.outputs, percentile), dims=left)


def _custom_groups(c: Coverage, f: Callable[[pd.Series], float], keys: list[str]) -> Coverage:
    outputs = list(c.outputs)
    schema = T.StructType([*(c.df.schema[d] for d in keys), *(T.StructField(o, T.DoubleType()) for o in outputs)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = {d: [frame[d].iloc[0]] for d in keys} | {o: [float(f(frame[o].dropna()))] for o in outputs}
        return pd.DataFrame(row)[[*keys, *outputs]]

    return c.with_df(c.df.groupBy(*keys).applyInPandas(run, schema), dims=keys)


def reduce_custom(c: Coverage, f: Callable[[pd.Series], float], dims: list[str] | None = None) -> Coverage:
    """A user's reduction of a series, one group at a time in a pandas worker."""
    return _custom_groups(c, f, [d for d in c.dims if dims is not None and d not in dims])


def group_reduce(c: Coverage, groupby: str, fn: str | Callable[[pd.Series], float], time: str = "time") -> Coverage:
    """Group time by dayofyear, weekofyear, season or month; the group takes time's place (seasons by code)."""
    if groupby not in ("dayofyear", "weekofyear", "season", "month"):
        raise ValueError(f"cannot group by {groupby!r}")
    key = calendar.part(F.col(time), "season_code" if groupby == "season" else groupby)
    grouped = c.with_df(c.df.withColumn(time, key))
    others = [d for d in c.dims if d != time]
    if callable(fn):
        return _custom_groups(grouped, fn, [*others, time])
    return c.with_df(_aggregated(grouped.df, [*others, time], fn, c.outputs), dims=[time if d == time else d for d in c.dims])


def bucket(time: Column, step: str) -> Column:
    """The start of the bucket "n,U" that a time falls in. Days and shorter count from the epoch, weeks
    begin on Mondays, months and years follow the calendar."""
    delta = tu.step(step)
    unit, n = tu.unit(delta), int(delta.astype(int))
    if unit in ("M", "Y"):
        months = n * (12 if unit == "Y" else 1)
        at = (F.year(time) - 1970) * 12 + F.month(time) - 1
        start = F.floor(at / months) * months
        return F.make_timestamp_ntz(F.lit(1970) + F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp")
    width = tu.micros(delta)
    offset = 4 * 86_400_000_000 if unit == "W" else 0
    us = F.unix_micros(time) - offset
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)) + offset)


def resample(c: Coverage, step: str, fn: str | Callable[[pd.Series], float], time: str = "time", spine: bool = True) -> Coverage:
    """Reduce within time buckets. With a spine every bucket between the first and the last appears for
    each combination of the other dimensions: empty ones sum to 0 and have no mean."""
    others = [d for d in c.dims if d != time]
    keyed = c.df.withColumn(time, bucket(F.col(time), step))
    if callable(fn):
        return _custom_groups(c.with_df(keyed), fn, [*others, time])
    out = _aggregated(keyed, [*others, time], fn, c.outputs)
    if spine:
        delta = tu.step(step)
        unit, n = tu.unit(delta), int(delta.astype(int))
        every = F.expr(f"interval {n * (12 if unit == 'Y' else 1)} month") if tu.nominal(delta) else F.expr(f"interval {tu.micros(delta)} microsecond")
        ends = out.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        times = ends.where("lo is not null").select(F.explode(F.sequence("lo", "hi", every)).alias(time))
        # the product of buckets and the other keys is the dense result itself
        keys = out.select(*others).distinct().crossJoin(times) if others else times
        empty = {"sum": 0.0, "count": 0.0, "prod": 1.0, "all": 1.0, "any": 0.0}
        fill = (lambda v: F.coalesce(v, F.lit(empty[fn]))) if fn in empty else (lambda v: v)
        out = keys.join(out, [*others, time], "left").select(*others, time, *(fill(F.col(o)).alias(o) for o in c.outputs))
    return c.with_df(out.select(*c.dims, *c.outputs))


def scaled(v: Column, low: Column | float, high: Column | float) -> Column:
    """To [0, 1]; outside it is missing."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    s = F.try_divide(v - low, high - low)
    return F.when((s >= 0) & (s <= 1), s)


#: Reductions that days can be reduced by first: (state of a day, result from the states).
MERGEABLE: dict[str, tuple[dict[str, Callable[[Column], Column]], Callable[[Callable[[str], Column]], Column]]] = {
    "min": ({"a": F.min}, lambda s: F.min(s("a"))),
    "max": ({"a": F.max}, lambda s: F.max(s("a"))),
    "sum": ({"a": F.sum}, lambda s: F.coalesce(F.sum(s("a")), F.lit(0.0))),
    "count": ({"n": lambda v: F.count(F.when(finite(v), 1))}, lambda s: F.coalesce(F.sum(s("n")), F.lit(0)).cast("double")),
    "mean": ({"a": F.sum, "n": F.count}, lambda s: F.try_divide(F.sum(s("a")), F.sum(s("n")))),
    "all": ({"a": lambda v: F.bool_and(_truth(v))}, lambda s: F.bool_and(s("a")).cast("double")),
    "any": ({"a": lambda v: F.bool_or(_truth(v))}, lambda s: F.bool_or(s("a")).cast("double")),
    "prod": ({"a": F.product}, lambda s: F.coalesce(F.product(s("a")), F.lit(1.0))),
}


def day_of_year_window(
    c: Coverage,
    window: int,
    fn: str | Callable[[pd.Series], float],
    time: str = "time",
    scale_float: tuple[float | Coverage, float | Coverage] | None = None,
    rescale: bool = False,
) -> Coverage:
    """For each day of year in the data, reduce all samples whose day lies within window // 2 of it on a
    circle of 365 days (day 366 counts as 365). ``scale_float`` is (low, high), numbers or coverages over dimensions
    of the source: values are scaled to [0, 1] first, and back afterwards with ``rescale``.

    Where the reduction can be merged, samples are reduced by key and day first, so at most 366 rows a key are
    spread over the days that they count for; other reductions spread the samples themselves."""
    others = [d for d in c.dims if d != time]
    if scale_float and any(isinstance(x, Coverage) for x in scale_float):
        c, scale_float, ends = _with_ends(c, scale_float)
    else:
        ends = None
    if not callable(fn) and fn in MERGEABLE:
        out = _merged_days(c, window, fn, time, scale_float)
    else:
        met = day_of_year_samples(c, window, time, scale_float)
        out = _custom_groups(c.with_df(met), fn, [*others, time]) if callable(fn) else c.with_df(_aggregated(met, [*others, time], fn, c.outputs), dims=[*others, time])
    if not rescale or not scale_float:
        return out
    if ends is None:
        low, high = (F.lit(float(x)) for x in scale_float)
        return out.mapped(lambda v: v * (high - low) + low)
    df = out.df.join(ends, [d for d in ends.columns if d in others], "left") if set(ends.columns) & set(others) else out.df.crossJoin(ends)
    return out.with_df(df.select(*out.dims, *((F.col(o) * (F.col("__high") - F.col("__low")) + F.col("__low")).alias(o) for o in out.outputs)))


def _with_ends(c: Coverage, scale: tuple[float | Coverage, float | Coverage]) -> tuple[Coverage, tuple[Column, Column], DataFrame]:
    """``c`` with the columns __low and __high beside its outputs, and the table of them by the dimensions they have."""
    table = None
    for name, x in zip(("__low", "__high"), scale, strict=True):
        if not isinstance(x, Coverage):
            table = table.withColumn(name, F.lit(float(x))) if table is not None else None
            continue
        own = x.df.select(*x.dims, F.col(x.outputs[0]).alias(name))
        shared = [d for d in x.dims if table is not None and d in table.columns]
        table = own if table is None else table.join(own, shared, "full_outer") if shared else table.crossJoin(own)
    if "__low" not in table.columns:
        table = table.withColumn("__low", F.lit(float(scale[0])))
    keys = [d for d in table.columns if d in c.dims]
    df = c.df.join(table, keys, "left") if keys else c.df.crossJoin(table)
    return c.with_df(df.select(*c.dims, *c.outputs, "__low", "__high")), (F.col("__low"), F.col("__high")), table


def scaled_cells(c: Coverage, scale: tuple | None) -> DataFrame:
    """The cells, their outputs scaled where there is a scale."""
    return c.df.select(*c.dims, *(scaled(F.col(o), *scale).alias(o) for o in c.outputs)) if scale else c.df.select(*c.dims, *c.outputs)


def wanted_days(c: Coverage, time: str) -> DataFrame:
    """The days of year in the data (``time``, 366 rows at most) and as days of a circle (__day)."""
    return c.df.select(F.dayofyear(time).cast("long").alias(time)).distinct().withColumn("__day", F.least(time, F.lit(365)).cast("long"))


def spread_days(df: DataFrame, window: int) -> DataFrame:
    """Rows once for every day (__day) whose window they lie in."""
    half = window // 2
    return df.withColumn("__to", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn("__day", F.pmod(F.col("__day") - 1 + F.col("__to"), F.lit(365)) + 1).drop("__to")


def _merged_days(c: Coverage, window: int, fn: str, time: str, scale: tuple | None) -> Coverage:
    others, (state, result) = [d for d in c.dims if d != time], MERGEABLE[fn]
    day = F.least(F.dayofyear(time), F.lit(365)).cast("long").alias("__day")
    days = scaled_cells(c, scale).groupBy(*others, day).agg(*(f(F.col(o)).alias(f"__{o}_{k}") for o in c.outputs for k, f in state.items()))
    met = spread_days(days, window).join(F.broadcast(wanted_days(c, time)), "__day")  # 366 rows at most
    return c.with_df(met.groupBy(*others, time).agg(*(result(lambda k, o=o: F.col(f"__{o}_{k}")).alias(o) for o in c.outputs)), dims=[*others, time])


def day_of_year_samples(c: Coverage, window: int, time: str, scale: tuple | None) -> DataFrame:
    """Each sample once for every day of year (``time``) whose window it lies in."""
    df = scaled_cells(c, scale).withColumn("__day", F.least(F.dayofyear(time), F.lit(365)).cast("long")).drop(time)
    return spread_days(df, window).join(F.broadcast(wanted_days(c, time)), "__day").drop("__day")  # 366 rows at most


def group_frame(df: DataFrame, keys: list[str], values: dict[str, Column]) -> Coverage:
    """Cells from an event table: mean of each value by key."""
    return Coverage(df.groupBy(*keys).agg(*(F.avg(v).alias(n) for n, v in values.items())), tuple(keys), tuple(values))
