"""Calendar parts of a time, as columns and as plan-time values."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("DJF", "MAM", "JJA", "SON")


def part(t: Column, unit: str) -> Column:
    """A part of a timestamp. Weeks are ISO weeks and Monday is weekday 0; ``season``, ``time`` and
    ``weekday_name`` are texts, all others whole numbers (long)."""
    numbers = {
        "day": F.dayofmonth(t),
        "dayofweek": F.weekday(t),
        "weekday": F.weekday(t),
        "dayofyear": F.dayofyear(t),
        "daysinmonth": F.dayofmonth(F.last_day(t)),
        "microsecond": F.pmod(F.unix_micros(t), F.lit(1_000_000)),
        "nanosecond": F.lit(0),
        "minute": F.minute(t),
        "month": F.month(t),
        "hour": F.hour(t),
        "quarter": F.quarter(t),
        "second": F.second(t),
        "week": F.weekofyear(t),
        "weekofyear": F.weekofyear(t),
        "year": F.year(t),
        "season_code": F.floor(F.pmod(F.month(t), F.lit(12)) / 3),
    }
    if unit in numbers:
        return numbers[unit].cast("long")
    if unit == "season":
        code = F.floor(F.pmod(F.month(t), F.lit(12)) / 3).cast("int")
        return F.element_at(F.array(*(F.lit(s) for s in SEASONS)), code + 1)
    if unit == "time":
        return F.date_format(t, "HH:mm:ss")
    if unit == "weekday_name":
        return F.date_format(t, "EEEE")
    raise ValueError(f"unknown calendar part {unit!r}")


UNITS = ("day", "dayofweek", "dayofyear", "daysinmonth", "microsecond", "minute", "month", "nanosecond", "quarter", "season", "second", "time", "week", "weekday", "weekday_name", "weekofyear", "year")


def parts_of(t: np.datetime64, unit: str) -> float:
    """The same of one value; texts come as their codes (season 0 to 3, seconds of the day, weekday)."""
    d = t.astype("datetime64[us]").astype(dt.datetime)
    iso = d.isocalendar()
    last = (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
    out = {
        "day": d.day, "dayofweek": d.weekday(), "weekday": d.weekday(), "weekday_name": d.weekday(), "dayofyear": d.timetuple().tm_yday, "daysinmonth": last.day,
        "microsecond": d.microsecond, "nanosecond": 0, "minute": d.minute, "hour": d.hour, "month": d.month, "quarter": (d.month - 1) // 3 + 1, "season": d.month % 12 // 3,
        "second": d.second, "time": d.hour * 3600 + d.minute * 60 + d.second, "week": iso.week, "weekofyear": iso.week, "year": d.year,
    }
    return float(out[unit])


def to_year(t: Column, year: int) -> Column:
    """The same moment of ``year``; 29 February becomes the 28th of a common year. The time of day stays."""
    months = (F.lit(year) - F.year(t)) * 12
    return t + F.make_interval(F.lit(0), months.cast("int"))
