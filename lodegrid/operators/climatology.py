"""Beta distributions by day of year: maximum likelihood by Newton's method, and quantiles by bisection
of the regularised incomplete beta function (continued fraction). A fit needs the sums of a group's values
and of their logarithms only, which are aggregated by day before windows spread them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.operators import reduce
from lodegrid.plans.coverage import Coverage

#: Values at the ends are moved inside by this much.
NUDGE = 1e-6


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def fit(values: np.ndarray) -> tuple[float, float]:
    """(a, b) of a Beta distribution on [0, 1]; NaN with fewer than two distinct values."""
    x = np.asarray(values, float)
    x = np.clip(x[~np.isnan(x)], NUDGE, 1 - NUDGE)
    if len(x) < 2 or x.min() == x.max():
        return math.nan, math.nan
    return fit_means(x.mean(), x.var(), np.log(x).mean(), np.log1p(-x).mean())


def fit_means(m: float, v: float, la: float, lb: float) -> tuple[float, float]:
    """(a, b) from the mean, the variance (for the start), and the means of log x and log(1 - x)."""
    k = max(m * (1 - m) / v - 1, 0.1)
    a, b = m * k, (1 - m) * k
    for _ in range(100):
        s = _digamma(a + b)
        g1, g2 = la - _digamma(a) + s, lb - _digamma(b) + s
        t = _trigamma(a + b)
        h11, h22 = t - _trigamma(a), t - _trigamma(b)
        det = h11 * h22 - t * t
        if det == 0:
            break
        da, db = -(h22 * g1 - t * g2) / det, -(h11 * g2 - t * g1) / det
        step = 1.0
        while a + step * da <= 0 or b + step * db <= 0:
            step /= 2
        a, b = a + step * da, b + step * db
        if abs(step * da) < 1e-10 * a and abs(step * db) < 1e-10 * b:
            break
    return a, b


def _fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def cumulative(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def quantile(a: float, b: float, p: float) -> float:
    if math.isnan(a):
        return math.nan
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cumulative(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def beta_fit(c: Coverage, window: int, percentiles: list[float], scale_float: tuple[float, float] | None = None, time: str = "time") -> Coverage:
    """Outputs a, b and d0, d1, ... (the percentiles' values in [0, 1]) by cell and day of year."""
    if c.outputs != ("value",):
        raise ValueError("a beta fit takes one output")
    others, keys = [d for d in c.dims if d != time], [*(d for d in c.dims if d != time), time]
    x = F.greatest(F.least(F.col("value"), F.lit(1 - NUDGE)), F.lit(NUDGE))
    parts = {"n": F.lit(1.0), "s": x, "q": x * x, "la": F.log(x), "lb": F.log1p(-x)}
    day = F.least(F.dayofyear(time), F.lit(365)).cast("long").alias("__day")
    known = reduce.scaled_cells(c, scale_float).where(F.col("value").isNotNull())
    days = known.groupBy(*others, day).agg(*(F.sum(v).alias(k) for k, v in parts.items()), F.min(x).alias("lo"), F.max(x).alias("hi"))
    met = reduce.spread_days(days, window).join(F.broadcast(reduce.wanted_days(c, time)), "__day")  # 366 rows at most
    sums = met.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in parts), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    outs = ["a", "b", *(f"d{i}" for i in range(len(percentiles)))]
    schema = T.StructType([*(sums.schema[d] for d in keys), *(T.StructField(o, T.DoubleType()) for o in outs)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                m = r.s / r.n
                a, b = fit_means(m, max(r.q / r.n - m * m, 1e-12), r.la / r.n, r.lb / r.n) if r.n >= 2 and r.lo < r.hi else (math.nan, math.nan)
                rows.append([a, b, *(quantile(a, b, p) for p in percentiles)])
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(rows, columns=outs, dtype=float)], axis=1)

    made = c.with_df(sums.mapInPandas(run, schema), dims=keys, outputs=outs)
    return made.mapped(lambda v: F.when(F.isnan(v), None).otherwise(v))
