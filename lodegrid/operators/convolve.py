"""Convolution as a shift join: cells are spread to the neighbours that they count for and summed.

The kernel is flipped (a true convolution) and centred as in mode "same". Cells beyond the source's
extent count as zero; a missing cell inside makes every result that it touches missing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.plans.coordinates import Axis, index_column
from lodegrid.plans.coverage import Coverage
from lodegrid.operators.interpolate import whole_index


def window_1d(kind: str, n: int, *args: float) -> np.ndarray:
    """A window of n points: boxcar, triang, hann, hamming, blackman, cosine, gaussian (deviation), exponential (decay)."""
    i = np.arange(n)
    centre = (n - 1) / 2
    if kind in ("boxcar", "mean"):
        return np.ones(n)
    if kind == "triang":
        return 1 - np.abs((i - centre) / ((n + 1) / 2 if n % 2 else n / 2))
    if kind in ("hann", "hamming", "blackman"):
        c = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}[kind]
        t = 2 * math.pi * i / max(1, n - 1)
        return c[0] - c[1] * np.cos(t) + c[2] * np.cos(2 * t)
    if kind == "cosine":
        return np.sin(math.pi / n * (i + 0.5))
    if kind in ("gaussian", "gauss"):
        return np.exp(-0.5 * ((i - centre) / args[0]) ** 2)
    if kind == "exponential":
        return np.exp(-np.abs(i - centre) / (args[0] if args else 1.0))
    raise ValueError(f"unknown window {kind!r}")


def kernel(text: str, ndim: int) -> np.ndarray:
    """"mean,N" or "<window>,N,arguments": the outer product over the dimensions, normalised to one."""
    name, n, *args = (p.strip() for p in text.split(","))
    line = window_1d(name, int(n), *map(float, args))
    out = line
    for _ in range(ndim - 1):
        out = np.multiply.outer(out, line)
    return out / out.sum()


def expansion(size: int) -> tuple[int, int]:
    """How many cells a kernel of ``size`` needs before and after a request."""
    return size // 2, max(size // 2 - (size + 1) % 2, 1)


def _indexed(c: Coverage, axes: dict[str, Axis]) -> DataFrame:
    """The cells with their position on each axis: by arithmetic on uniform ones, by a join on listed ones."""
    df = c.df
    for d, a in axes.items():
        if a.uniform:
            df = df.withColumn(index_column(d), whole_index(F.col(d), a))
        else:
            df = df.join(F.broadcast(a.frame(df.sparkSession)), d)  # a list of the plan
    return df


def convolve(c: Coverage, weights: np.ndarray, axes: dict[str, Axis]) -> Coverage:
    """Convolve over the dimensions in ``axes`` (in the kernel's order), by position; others are batch dimensions.
    The kernel is a literal array: each cell is exploded by its non-zero entries, and sums are combined
    partially, so the shuffle carries a row for each cell and offset at most."""
    weights = np.asarray(weights, float)
    dims = list(axes)
    if weights.ndim != len(dims):
        raise ValueError(f"a kernel of {weights.ndim} dimensions does not fit {dims}")
    # mode "same": output i gets sum over j of kernel[j] * source[i + (size - 1) // 2 - j]
    entries = [[*(int(j) - (s - 1) // 2 for j, s in zip(at, weights.shape, strict=True)), float(w)] for at, w in np.ndenumerate(weights)]
    offsets = F.array(*(F.struct(*(F.lit(e[k]).alias(f"o{k}") for k in range(len(dims))), F.lit(e[-1]).alias("w")) for e in entries))
    others = [d for d in c.dims if d not in axes]
    outs = list(c.outputs)
    indexed = _indexed(c, axes)
    src = indexed.select(*others, *(f"__i_{d}" for d in dims), *outs, F.explode(offsets).alias("__o"))
    moved = src.select(*others, *((F.col(f"__i_{d}") + F.col(f"__o.o{k}")).alias(f"__i_{d}") for k, d in enumerate(dims)), *(F.when(F.col("__o.w") == 0, F.when(F.col(o).isNotNull(), 0.0)).otherwise(F.col(o) * F.col("__o.w")).alias(o) for o in outs))
    for d, a in axes.items():
        moved = moved.where((F.col(f"__i_{d}") >= 0) & (F.col(f"__i_{d}") < a.size))
    keys = [*others, *(f"__i_{d}" for d in dims)]
    summed = moved.groupBy(*keys).agg(*(F.when(F.count(o) == F.count("*"), F.sum(o)).alias(o) for o in outs))
    cells = indexed.select(*c.dims, *(f"__i_{d}" for d in dims))
    return c.with_df(cells.join(summed, keys, "left").select(*c.dims, *outs))


def separable(weights: np.ndarray) -> list[np.ndarray] | None:
    """The lines whose outer product a kernel is, or None."""
    lines, rest = [], np.asarray(weights, float)
    while rest.ndim > 1:
        flat = rest.reshape(rest.shape[0], -1)
        u, s, v = np.linalg.svd(flat)
        if s[0] == 0 or s[1:].max(initial=0) > 1e-12 * s[0]:
            return None
        lines.append(u[:, 0] * s[0])
        rest = v[0].reshape(rest.shape[1:])
    return [*lines, rest]


def convolve_1d(c: Coverage, weights: list[float], dim: str) -> Coverage:
    """Along one dimension whose cells are complete, by lags and leads within the other dimensions: one
    sort, no explosion. The batch dimensions are the keys that split the work."""
    others = [d for d in c.dims if d != dim]
    order = Window.partitionBy(*others).orderBy(dim)
    half = (len(weights) - 1) // 2

    def line(v):
        total, n = F.lit(0.0), F.row_number().over(order)
        count = F.count("*").over(Window.partitionBy(*others))
        for j, w in enumerate(weights):
            k = half - j
            at = F.lead(v, k).over(order) if k >= 0 else F.lag(v, -k).over(order)
            out_of = (n + k < 1) | (n + k > count)
            total = total + F.when(out_of, 0.0).otherwise(at) * F.lit(float(w))
        return total

    return c.mapped(line)
