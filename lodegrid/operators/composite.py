"""Composition of coverages: by priority, and as tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.plans.coverage import Coverage


def _ranked(sources: list[Coverage], dims: list[str], outputs: list[str]) -> DataFrame:
    """All sources under each other with their priority; outputs that a source lacks are missing."""
    frames = [s.df.select(*dims, *(F.col(o) if o in s.outputs else F.lit(None).cast("double").alias(o) for o in outputs), F.lit(i).alias("__p")) for i, s in enumerate(sources)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _check(sources: list[Coverage]) -> tuple[list[str], list[str]]:
    if not sources:
        raise ValueError("a composition needs a source")
    dims = list(sources[0].dims)
    if any(set(s.dims) != set(dims) for s in sources):
        raise ValueError("all sources need the same dimensions")
    single = {s.outputs == ("value",) for s in sources}
    if len(single) > 1:
        raise ValueError("sources must all be single-output or all multi-output")
    return dims, list(dict.fromkeys(o for s in sources for o in s.outputs))


def tile(sources: list[Coverage]) -> Coverage:
    """The union of all cells; where several sources have one, the first known value wins for each output.
    One aggregate over the union, partial before the shuffle, however many sources there are."""
    dims, outputs = _check(sources)
    first = [F.min_by(o, F.when(F.col(o).isNotNull(), F.col("__p"))).alias(o) for o in outputs]
    return sources[0].with_df(_ranked(sources, dims, outputs).groupBy(*dims).agg(*first), dims=dims, outputs=outputs)


def ordered(sources: list[Coverage], request: DataFrame, with_index: bool = False) -> Coverage:
    """For each requested cell and output the first finite value in order of the sources. ``with_index``
    adds which source gave the first output ("source_index", missing if none)."""
    dims, outputs = _check(sources)
    known = lambda o: F.when(F.col(o).isNotNull() & (F.abs(F.col(o)) < float("inf")), F.col("__p"))
    picks = [F.min_by(o, known(o)).alias(o) for o in outputs]
    if with_index:
        picks.append(F.min(known(outputs[0])).cast("double").alias("source_index"))
    best = _ranked(sources, dims, outputs).groupBy(*dims).agg(*picks)
    outs = [*outputs, *(["source_index"] if with_index else [])]
    return sources[0].with_df(request.select(*dims).join(best, dims, "left"), dims=dims, outputs=outs)


def pruned(sources: list[tuple[object, Coverage]], lo: object, hi: object) -> list[Coverage]:
    """Sources whose own coordinate lies within the request's bounds, at plan time."""
    return [c for at, c in sources if lo <= at <= hi]
