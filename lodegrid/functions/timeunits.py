"""Time steps, precision and calendar arithmetic at plan time.

A step is a string "n,U" with numpy's unit letters (Y M D h m s ms us ns). Precision matters: bounds
are compared at the coarser precision where a selection widens, and a coarse upper bound stands for
the whole of its unit where it narrows.
"""

from __future__ import annotations

import calendar
import datetime as dt

import numpy as np

#: Units from coarse to fine.
UNITS = ("Y", "M", "W", "D", "h", "m", "s", "ms", "us", "ns")
_MICROS = {"W": 604_800_000_000, "D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}


def step(text: str | np.timedelta64 | dt.timedelta | float) -> np.timedelta64 | float:
    """A step from "n,U", a timedelta, or a number."""
    if isinstance(text, str):
        n, _, unit = text.partition(",")
        if unit not in UNITS:
            raise ValueError(f"invalid time step {text!r}: expected 'n,U' with a unit of {UNITS}")
        return np.timedelta64(int(n), unit)
    if isinstance(text, dt.timedelta):
        return np.timedelta64(text)
    return text if isinstance(text, np.timedelta64) else float(text)


def step_text(value: np.timedelta64) -> str:
    unit, _ = np.datetime_data(value.dtype)
    return f"{int(value.astype(np.int64))},{unit}"


def value(v: object) -> float | np.datetime64 | np.timedelta64:
    """A coordinate value: numbers are floats, dates and texts are times, "n,U" are steps."""
    if isinstance(v, (np.datetime64, np.timedelta64)):
        return v
    if isinstance(v, str):
        if "," in v:
            return step(v)
        return np.datetime64(v.replace(" ", "T").removesuffix("Z"))
    if isinstance(v, (dt.datetime, dt.date)):
        if isinstance(v, dt.datetime) and v.tzinfo is not None:
            v = v.astimezone(dt.UTC).replace(tzinfo=None)
        return np.datetime64(v)
    if isinstance(v, bool) or v is None:
        raise ValueError(f"invalid coordinate value {v!r}")
    return float(v)


def unit(v: np.datetime64 | np.ndarray) -> str:
    return np.datetime_data(v.dtype)[0]


def finer(a: str, b: str) -> bool:
    """Whether unit a is finer than unit b."""
    return UNITS.index(a) > UNITS.index(b)


def nominal(delta: np.timedelta64) -> bool:
    return unit(delta) in ("Y", "M")


def add(start: np.datetime64, delta: np.timedelta64, times: int = 1) -> np.datetime64:
    """start + times * delta; years and months keep the day of the month or clamp to its last."""
    if not nominal(delta):
        return start + delta * times
    n = int(delta.astype(np.int64)) * times * (12 if unit(delta) == "Y" else 1)
    if unit(start) in ("Y", "M"):
        return (start.astype("datetime64[M]") + n).astype(f"datetime64[{unit(start) if unit(delta) != 'M' else 'M'}]")
    month = start.astype("datetime64[M]")
    within = start - month.astype(start.dtype)
    day = int((start.astype("datetime64[D]") - month.astype("datetime64[D]")).astype(int)) + 1
    to = month + n
    year, number = divmod(int(to.astype(int)), 12)
    last = calendar.monthrange(1970 + year, number + 1)[1]
    back = np.timedelta64(max(0, day - last), "D")
    return to.astype(start.dtype) + within - back


def micros(v: np.datetime64 | np.timedelta64) -> int:
    """Microseconds (since the epoch, for times); Spark keeps no finer ones."""
    if isinstance(v, np.timedelta64):
        u, n = np.datetime_data(v.dtype)
        if u in _MICROS:
            return int(v.astype(np.int64)) * n * _MICROS[u]
        return int(v.astype("timedelta64[us]").astype(np.int64))
    return int(v.astype("datetime64[us]").astype(np.int64))


def divide(a: np.timedelta64, b: np.timedelta64) -> float:
    return micros(a) / micros(b)


def divisible(a: np.timedelta64, b: np.timedelta64) -> bool:
    return micros(a) % micros(b) == 0


def coarser_bounds(mine: list, other: list, outer: bool) -> tuple[list, list]:
    """Both bounds at one precision: the other's come down to mine if they are finer and ``outer``; else mine take theirs."""
    if finer(unit(other[0]), unit(mine[0])) and outer:
        return mine, [b.astype(mine[0].dtype) for b in other]
    return [b.astype(other[0].dtype) for b in mine], other


def widened(other: list, axis_unit: str, outer: bool) -> list:
    """The other's bounds at the axis's finer precision, the upper one at the end of its own unit."""
    if finer(axis_unit, unit(other[0])) and outer:
        kind = f"datetime64[{axis_unit}]"
        return [other[0].astype(kind), (other[1] + 1).astype(kind) - 1]
    return other
