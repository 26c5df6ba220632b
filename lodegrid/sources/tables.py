"""Reading tables: Parquet, ORC, CSV and JSON as coverages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.plans.coverage import Coverage


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose times without a zone are read as UTC timestamps by the reader itself, so that
    filters on them still reach the row groups (a cast above the scan would stop them)."""
    df = spark.read.parquet(path)
    if not any(isinstance(f.dataType, T.TimestampNTZType) for f in df.schema):
        return df
    schema = T.StructType([T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, f.nullable) for f in df.schema])
    return spark.read.schema(schema).parquet(path)


def zoned(df: DataFrame) -> DataFrame:
    """Times without a zone as UTC timestamps, for tables that do not come from ``read_parquet``."""
    casts = {f.name: F.col(f"`{f.name}`").cast("timestamp") for f in df.schema if isinstance(f.dataType, (T.TimestampNTZType, T.DateType))}
    return df.withColumns(casts) if casts else df


#: Column names that are taken for dimensions where nothing else is said.
KEYS = {"lat": ("lat", "latitude"), "lon": ("lon", "longitude"), "alt": ("alt", "altitude"), "time": ("time", "datetime")}


def csv(
    spark: SparkSession,
    path: str,
    header: bool = True,
    lat_key: str | int | None = None,
    lon_key: str | int | None = None,
    alt_key: str | int | None = None,
    time_key: str | int | None = None,
    data_key: str | int | list | None = None,
    schema: T.StructType | str | None = None,
) -> Coverage:
    """A CSV of points. Keys are column names, or positions (the only way without a header). Data keys
    default to all other columns; one is called "value". Two or more dimensions make a stack: each row
    is a point. Without a ``schema`` dimensions and data are read as texts and cast, so no pass over the
    data infers types."""
    df = spark.read.csv(path, header=header, schema=schema)
    at = lambda k: df.columns[k] if isinstance(k, int) else k
    keys = {d: at(k) for d, k in (("lat", lat_key), ("lon", lon_key), ("alt", alt_key), ("time", time_key)) if k is not None}
    for d, names in KEYS.items():
        if d not in keys:
            keys |= {d: n for n in names if n in df.columns}
    dims = sorted(keys, key=lambda d: df.columns.index(keys[d]))
    data = [at(k) for k in (data_key if isinstance(data_key, list) else [data_key])] if data_key is not None else [c for c in df.columns if c not in keys.values()]
    if not data:
        raise ValueError("No data keys found")
    outs = ["value"] if len(data) == 1 else data
    cast = lambda d: F.col(f"`{keys[d]}`").cast("timestamp" if d == "time" else "double").alias(d)
    picked = df.select(*(cast(d) for d in dims), *(F.col(f"`{c}`").cast("double").alias(o) for c, o in zip(data, outs, strict=True)))
    return Coverage.of(picked, dims, outs, stacked="_".join(dims) if len(dims) > 1 else None)


def decode_cf_time(df: DataFrame, column: str, units: str) -> DataFrame:
    """A numeric time with CF units ("days since 1970-01-01") as a timestamp, in the standard calendar."""
    unit, _, origin = units.partition(" since ")
    micros = {"seconds": 1e6, "second": 1e6, "s": 1e6, "minutes": 6e7, "minute": 6e7, "hours": 3.6e9, "hour": 3.6e9, "h": 3.6e9, "days": 8.64e10, "day": 8.64e10, "d": 8.64e10}
    if unit.strip().lower() not in micros:
        raise ValueError(f"unknown CF units {units!r}")
    start = F.unix_micros(F.to_timestamp(F.lit(origin.strip().replace("T", " "))))
    return df.withColumn(column, F.timestamp_micros(start + F.round(F.col(column) * micros[unit.strip().lower()]).cast("long")))


def with_boundary(c: Coverage, boundary: dict[str, float]) -> Coverage:
    """Cell extents: for each dimension columns <dim>_lo and <dim>_hi, half widths around the point."""
    bad = [d for d, b in boundary.items() if not isinstance(b, (int, float))]
    if bad:
        raise NotImplementedError(f"only centred scalar boundaries are supported, not those of {bad}")
    df = c.df.withColumns({f"{d}_{e}": F.col(d) + s * float(b) for d, b in boundary.items() for e, s in (("lo", -1), ("hi", 1))})
    return c.with_df(df).with_attrs(boundary=boundary)
