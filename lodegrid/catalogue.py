"""Registry of the engine's queries over the driver's tables, and of the SQL that gives the same rows.

Tables seen as coverages: L is ``lineitem`` (time, station), G a 20 x 25 grid of highest prices, P highest prices by
part size, E events (time, station). Doubles are rounded on both sides (means to seven places, as means of cents over 2^k samples would tie
at fewer) and times come as
microseconds since the epoch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.functions import calendar, crs
from lodegrid.operators import algebra, climatology, composite, convolve, interpolate, reduce, rewrite
from lodegrid.operators.caches import HashCache, PartialCache
from lodegrid.operators.managers import ParallelOutput
from lodegrid.operators.nodes import Arithmetic, Mean, OrderedCompositor, Reproject, TileCompositor
from lodegrid.plans.coordinates import DIMENSIONS, Axis, Coordinates, UniformAxis, add_valid_dimension, concat, union
from lodegrid.plans.coverage import Coverage
from lodegrid.plans.node import Node
from lodegrid.sources.nodes import Array, Table
from lodegrid.sources.tables import read_parquet

for _d in {"size", "station"} - set(DIMENSIONS):
    add_valid_dimension(_d)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# -- views -------------------------------------------------------------------------------------
def lines(spark: SparkSession, sf: str) -> Coverage:
    df = read_parquet(spark, f"{sf}/lineitem.parquet")
    flag = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    cells = df.select(F.col("l_shipdate").alias("time"), F.col("l_suppkey").alias("station"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"), flag.alias("flag"))
    return Coverage.of(cells, ["time", "station"], ["value", "quantity", "flag"])


L = "(SELECT l_shipdate AS time, l_suppkey AS station, l_extendedprice AS value, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS flag FROM lineitem)"


def events(spark: SparkSession, sf: str) -> Coverage:
    df = read_parquet(spark, f"{sf}/events.parquet")
    return Coverage.of(df.select(F.col("ts").alias("time"), F.col("user_id").alias("station"), "value"), ["time", "station"])


E_ = "(SELECT ts AS time, user_id AS station, value FROM events)"
LAT, LON = UniformAxis(0, 19, size=20, name="lat"), UniformAxis(0, 24, size=25, name="lon")


def grid(spark: SparkSession, sf: str, gaps: bool = False) -> Coverage:
    df = read_parquet(spark, f"{sf}/lineitem.parquet")
    lat, lon = (F.col("l_suppkey") % 20).cast("double"), (F.col("l_partkey") % 25).cast("double")
    cells = df.groupBy(lat.alias("lat"), lon.alias("lon")).agg(F.max("l_extendedprice").alias("value"))
    c = Coverage.of(cells, ["lat", "lon"])
    return c.mapped(lambda v: F.when((F.col("lat") * 3 + F.col("lon")) % 7 != 0, v)) if gaps else c


G = "(SELECT (l_suppkey % 20)::DOUBLE AS lat, (l_partkey % 25)::DOUBLE AS lon, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
GAPS = f"(SELECT lat, lon, CASE WHEN (lat * 3 + lon) % 7 <> 0 THEN value END AS value FROM {G})"
SIZE = UniformAxis(1, 50, size=50, name="size")


def sizes(spark: SparkSession, sf: str) -> Coverage:
    df = read_parquet(spark, f"{sf}/part.parquet")
    cells = df.groupBy(F.col("p_size").cast("double").alias("size")).agg(F.max("p_retailprice").alias("value"))
    return Coverage.of(cells, ["size"])


P = "(SELECT p_size::DOUBLE AS size, max(p_retailprice) AS value FROM part GROUP BY 1)"


def shown(c: Coverage, places: int = 4) -> DataFrame:
    """Rounded values, and times as microseconds."""
    kinds = c.df.schema
    dims = [F.unix_micros(d).alias(d) if isinstance(kinds[d].dataType, T.TimestampType) else F.col(d) for d in c.dims]
    return c.df.select(*dims, *(F.round(o, places).alias(o) for o in c.outputs))


# -- scans (S1, S2, P7, C2-C8) -------------------------------------------------------------------
LO, HI = "1996-03-01", "1997-02-28"
_query("scan_bounds", f"SELECT epoch_us(time) AS time, station, round(value, 4) AS value FROM {L} WHERE time >= '{LO}' AND time <= '{HI}'")(
    lambda s, d: shown(lines(s, d).select("value").within({"time": _bounds(LO, HI)}))
)
_query("scan_outer_bounds", f"SELECT size, round(value, 4) AS value FROM {P} WHERE size >= (SELECT max(size) FROM {P} WHERE size <= 10.5) AND size <= (SELECT min(size) FROM {P} WHERE size >= 20.5)")(
    lambda s, d: shown(sizes(s, d).within({"size": SIZE.select((10.5, 20.5), outer=True).bounds}))
)
_query("scan_nan_vals", f"SELECT station, count(value) AS known FROM (SELECT station, CASE WHEN quantity NOT IN (1, 50) THEN quantity END AS value FROM {L}) GROUP BY 1")(
    lambda s, d: Coverage.of(lines(s, d).df, ["time", "station"], ["quantity"], nan_vals=[1, 50]).df.groupBy("station").agg(F.count("quantity").alias("known"))
)
_query("find_bounds", f"SELECT epoch_us(min(time)) AS time_min, epoch_us(max(time)) AS time_max, min(station) AS station_min, max(station) AS station_max FROM {L}")(
    lambda s, d: lines(s, d).df.agg(F.unix_micros(F.min("time")).alias("time_min"), F.unix_micros(F.max("time")).alias("time_max"), F.min("station").alias("station_min"), F.max("station").alias("station_max"))
)
_query("find_coordinates", f"SELECT DISTINCT station FROM {L}")(lambda s, d: lines(s, d).df.select("station").distinct())
_query("coords_intersect", f"SELECT size FROM (SELECT DISTINCT size FROM {P}) WHERE size BETWEEN 12 AND 31")(
    lambda s, d: sizes(s, d).within({"size": Coordinates.grid(lat=[12, 20, 31]).bounds["lat"]}).df.select("size").distinct()
)


def _bounds(lo: str, hi: str) -> list:
    return Axis([lo, hi], "time").bounds


# -- coordinate sets (C9-C19) --------------------------------------------------------------------
_query("grid_crossjoin", "SELECT a.i::DOUBLE * 2.5 AS lat, 100.0 - b.i * 0.5 AS lon FROM range(5) a(i), range(7) b(i)")(
    lambda s, d: Coordinates.grid(lat=(0, 10, 5), lon=(100, 97, 7)).frame(s, index=False)
)
_query("coords_stacked", "SELECT i::DOUBLE AS lat, (10 - i)::DOUBLE AS lon, epoch_us(TIMESTAMP '2018-01-01' + to_days(i::INT)) AS time FROM range(4) r(i)")(
    lambda s, d: _micros(Coordinates.points(lat=[0, 1, 2, 3], lon=[10, 9, 8, 7], time=("2018-01-01", "2018-01-04", "1,D")).frame(s, index=False))
)
_query("coords_months", "SELECT epoch_us(TIMESTAMP '2018-01-31' + to_months(i::INT)) AS time FROM range(13) r(i)")(
    lambda s, d: _micros(Coordinates([UniformAxis("2018-01-31", "2019-01-31", "1,M", name="time")]).frame(s, index=False))
)
_query("coords_concat", "SELECT i::DOUBLE AS lat FROM range(6) r(i) UNION ALL SELECT i::DOUBLE AS lat FROM range(4, 9) r(i)")(
    lambda s, d: concat([Coordinates.grid(lat=(0, 5, 6)), Coordinates.grid(lat=(4, 8, 5))]).frame(s, index=False)
)
_query("coords_union", "SELECT i::DOUBLE AS lat FROM range(6) r(i) UNION SELECT i::DOUBLE AS lat FROM range(4, 9) r(i)")(
    lambda s, d: union([Coordinates.grid(lat=(0, 5, 6)), Coordinates.grid(lat=(4, 8, 5))]).frame(s, index=False)
)
_query("coords_unique", f"SELECT DISTINCT epoch_us(date_trunc('month', time)) AS time FROM {L}")(lambda s, d: lines(s, d).df.select(F.unix_micros(F.date_trunc("month", "time")).alias("time")).distinct())
_query("coords_issubset", f"SELECT count(*) = 0 AS subset FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)")(
    lambda s, d: lines(s, d).df.select("station").distinct().join(read_parquet(s, f"{d}/supplier.parquet"), F.col("station") == F.col("s_suppkey"), "left_anti").agg((F.count("*") == 0).alias("subset"))
)
_query("coords_affine", "SELECT 49.5 - r AS lat, 10.25 + c * 0.5 AS lon FROM range(4) a(r), range(6) b(c)")(
    lambda s, d: Coordinates.from_geotransform((10, 0.5, 0, 50, 0, -1), (4, 6)).frame(s, index=False)
)
_query("coords_polar", "SELECT round(5 + r * sin(t * pi() / 2), 4) AS lat, round(6 + r * cos(t * pi() / 2), 4) AS lon FROM (VALUES (1.0), (2.0)) a(r), range(4) b(t)")(
    lambda s, d: _rounded(_polar().frame(s), ["lat", "lon"])
)
_query("chunk_ids", "SELECT floor(a.i / 4)::BIGINT * 3 + floor(b.i / 3)::BIGINT AS chunk, count(*) AS cells FROM range(10) a(i), range(8) b(i) GROUP BY 1")(
    lambda s, d: Coordinates.grid(lat=(0, 9, 10), lon=(0, 7, 8)).frame(s).select((F.floor(F.col("__i_lat") / 4) * 3 + F.floor(F.col("__i_lon") / 3)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("cells"))
)


def _polar():
    from lodegrid.plans.coordinates import PolarGrid

    return PolarGrid((5, 6), [1, 2], theta_size=4)


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*((F.round(c, 4) + 0.0).alias(c) for c in cols))


def _micros(df: DataFrame) -> DataFrame:
    return df.withColumn("time", F.unix_micros("time"))


# -- generated sources (S17-S19) -----------------------------------------------------------------
_REQ = Coordinates.grid(lat=(0, 90, 7), lon=(-180, 180, 9))
_REQ_SQL = "(SELECT a.i * 15.0::DOUBLE AS lat, -180 + b.i * 45.0::DOUBLE AS lon, (a.i * 9 + b.i)::DOUBLE AS value FROM range(7) a(i), range(9) b(i))"
_query("arange", f"SELECT lat, lon, value FROM {_REQ_SQL}")(lambda s, d: algebra.index_grid(_REQ.frame(s), ["lat", "lon"], [7, 9]).df)
_query("coord_data", f"SELECT lat, lon, lon AS value FROM {_REQ_SQL}")(lambda s, d: algebra.coordinate_data(_REQ.frame(s), ["lat", "lon"], "lon").df)
_query("sin_coords", f"SELECT lat, lon, round(sin(pi() * lat / 90) * sin(pi() * lon / 90), 4) + 0.0 AS value FROM {_REQ_SQL}")(
    lambda s, d: _plus_zero(algebra.sine_waves(_REQ.frame(s), ["lat", "lon"]))
)


def _plus_zero(c: Coverage) -> DataFrame:
    return c.df.select(*c.dims, *((F.round(o, 4) + 0.0).alias(o) for o in c.outputs))


# -- projections (P1-P6, U*) ---------------------------------------------------------------------
def _arith(eqn: str, **params: object) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        c = grid(s, d, gaps=True)
        return shown(algebra.arithmetic(eqn, {"a": c, "b": c.mapped(lambda v: F.col("lat") + 1)} if "b" in eqn else {"a": c}, params or None), 3)

    return run


_AB = f"(SELECT lat, lon, value AS a, lat + 1 AS b FROM {GAPS})"
for _name, _eqn, _sql, _params in (
    ("linear", "{k} * a + {m}", "2 * a + 5", {"k": 2, "m": 5}),
    ("two_inputs", "a / b - b ** 2", "a / b - pow(b, 2)", {}),
    ("bool", "(a < 40000) + (a >= 30000) * b", "CASE WHEN a IS NULL THEN NULL ELSE (a < 40000)::INT + (a >= 30000)::INT * b END", {}),
    ("where", "where((a > 38000) & (b < 10), a, -b)", "CASE WHEN a IS NULL AND b < 10 THEN NULL WHEN a > 38000 AND b < 10 THEN a ELSE -b END", {}),
    ("modulo", "a % 7 + a // 1000", "CASE WHEN a IS NOT NULL THEN a - 7 * floor(a / 7) + floor(a / 1000) END", {}),
    ("functions", "log10(a) + sqrt(b) * sin(b) + arctan2(a, b)", "log10(a) + sqrt(b) * sin(b) + atan2(a, b)", {}),
):
    _query(f"arith_{_name}", f"SELECT lat, lon, round({_sql}, 3)::DOUBLE AS value FROM {_AB}")(_arith(_eqn, **_params))

for _op, _name in (("==", "eq"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    _query(f"mask_{_name}", f"SELECT lat, lon, CASE WHEN lat {'=' if _op == '==' else _op} 7 THEN NULL ELSE round(value, 4) END AS value FROM {G}")(
        lambda s, d, op=_op: shown(algebra.mask_by_self(grid(s, d), bool_val=7, bool_op=op, mask_output="lat"))
    )
_query("mask_value_joined", f"SELECT lat, lon, CASE WHEN lat % 2 = 1 THEN -9999.0 ELSE round(value, 4) END AS value FROM {G}")(
    lambda s, d: shown(algebra.mask(grid(s, d), _parity(s), masked_val=-9999.0))
)
_query("combine_outputs", f"SELECT lat, lon, round(value, 6) AS price, round(value / (lat + lon + 3), 6) AS share FROM {G}")(
    lambda s, d: _combined(grid(s, d))
)
_query("units_convert", f"SELECT lat, lon, round(value * 0.3048, 7) AS value FROM {G}")(lambda s, d: shown(algebra.convert(grid(s, d).with_attrs(units="ft"), "m"), 7))
_query("units_add", f"SELECT lat, lon, round(value + lat * 1000, 4) AS value FROM {G}")(
    lambda s, d: shown(algebra.binary("+", grid(s, d).with_attrs(units="m"), grid(s, d).mapped(lambda v: F.col("lat")).with_attrs(units="km")))
)


def _parity(s: SparkSession) -> Coverage:
    return Coverage(LAT.frame(s).select("lat", (F.col("lat") % 2).alias("value")), ("lat",))


def _combined(c: Coverage) -> DataFrame:
    other = c.mapped(lambda v: v / (F.col("lat") + F.col("lon") + 3))
    return shown(algebra.combine({"price": c, "share": other}, check=False), 6)


# -- reductions (A1-A13) -------------------------------------------------------------------------
_REDUCE = {
    "min": "min(value)", "max": "max(value)", "sum": "coalesce(sum(value), 0)", "count": "count(value)::DOUBLE", "mean": "avg(value)", "var": "var_pop(value)", "std": "stddev_pop(value)",
    "median": "median(value)", "pct90": "quantile_cont(value, 0.9)", "skew": "skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0))", "kurt": "kurtosis_pop(value)",
}


def _reduce(fn: str, dims: list[str] | None) -> Query:
    name, p = ("percentile", 90.0) if fn == "pct90" else ("kurtosis" if fn == "kurt" else fn, None)
    return lambda s, d: shown(reduce.reduce(lines(s, d).select("value"), name, dims, p), _places(fn))


def _places(fn: str) -> int:
    return {"mean": 7, "var": 2}.get(fn, 4)


def _whole_places(fn: str) -> int:
    return {"mean": 7, "prod": 8}.get(fn, 4)


for _fn, _sql in _REDUCE.items():
    _query(f"reduce_{_fn}_all", f"SELECT round({_sql}, {_places(_fn)}) AS value FROM {L}")(_reduce(_fn, None))
    _query(f"reduce_{_fn}_time", f"SELECT station, round({_sql}, {_places(_fn)}) AS value FROM {L} GROUP BY station")(_reduce(_fn, ["time"]))
    _query(f"reduce_{_fn}_station", f"SELECT epoch_us(time) AS time, round({_sql.replace('skewness(value)', 'CASE WHEN count(value) > 2 AND min(value) < max(value) THEN skewness(value) END').replace('kurtosis_pop(value)', 'CASE WHEN min(value) < max(value) THEN kurtosis_pop(value) END').replace('sqrt(count(value) * (count(value) - 1.0))', 'nullif(sqrt(count(value) * (count(value) - 1.0)), 0)')}, {_places(_fn)}) AS value FROM {L} GROUP BY time")(
        _reduce(_fn, ["station"]) if _fn not in ("skew",) else (lambda s, d: _skew_of_three(s, d))
    )


def _skew_of_three(s: SparkSession, d: str) -> DataFrame:
    """The oracle's correction has no value for two samples, so those groups are missing on both sides."""
    c = lines(s, d).select("value")
    n = F.count("value")
    value = F.when(n > 2, reduce.AGGREGATES["skew"](F.col("value")))
    return shown(c.with_df(c.df.groupBy("time").agg(value.alias("value")), dims=["time"]))


_query("reduce_multi_output", f"SELECT station, round(avg(value), 7) AS value, round(avg(quantity), 7) AS quantity, round(avg(flag), 7) AS flag FROM {L} GROUP BY 1")(lambda s, d: shown(reduce.reduce(lines(s, d), "mean", ["time"]), 7))
# groups that are empty, as the data have none; factors near 1 keep products over all rows comparable
_FACTOR = "1 + (quantity - 25) / 1000000"
for _fn, _sql in (("sum", "coalesce(sum(v), 0.0)"), ("mean", "avg(v)"), ("prod", "coalesce(product(v), 1.0)")):
    _query(f"reduce_{_fn}_empty", f"SELECT station, round({_sql}, {_whole_places(_fn)})::DOUBLE AS value FROM (SELECT station, CASE WHEN station % 2 = 0 THEN {_FACTOR if _fn == 'prod' else 'quantity / 25'} END AS v FROM {L}) GROUP BY 1")(
        lambda s, d, fn=_fn: _empty(s, d, fn)
    )


def _empty(s: SparkSession, d: str, fn: str) -> DataFrame:
    v = F.expr(_FACTOR) if fn == "prod" else F.col("quantity") / 25
    c = Coverage.of(lines(s, d).df.select("time", "station", F.when(F.col("station") % 2 == 0, v).alias("value")), ["time", "station"])
    return shown(reduce.reduce(c, fn, ["time"]), _whole_places(fn))


_query("reduce_custom_range", f"SELECT station, round(max(value) - min(value), 4) AS value FROM {L} GROUP BY 1")(lambda s, d: shown(reduce.reduce_custom(lines(s, d).select("value"), lambda v: v.max() - v.min(), ["time"])))

# -- calendar groups (A14, A15), buckets (A16), windows (A17) --------------------------------------
_GROUPS = {"dayofyear": "dayofyear(time)", "month": "month(time)", "season": "((month(time) % 12) // 3)", "weekofyear": "week(time)"}
_GROUP_FNS = {"mean": "avg(quantity)", "sum": "sum(quantity)", "count": "count(quantity)::DOUBLE", "std": "stddev_pop(quantity)", "any": "bool_or(flag <> 0)::INT::DOUBLE", "all": "bool_and(flag <> 0)::INT::DOUBLE"}
for _g, _gsql in _GROUPS.items():
    for _fn, _sql in _GROUP_FNS.items():
        _query(f"group_{_g}_{_fn}", f"SELECT {_gsql}::BIGINT AS time, round({_sql}, {_places(_fn)}) AS value FROM {L} GROUP BY 1")(
            lambda s, d, g=_g, fn=_fn: shown(reduce.group_reduce(reduce_all_stations(lines(s, d).select("flag" if fn in ("any", "all") else "quantity")), g, fn), _places(fn))
        )
    _query(f"group_{_g}_prod", f"SELECT {_gsql}::BIGINT AS time, round(product({_FACTOR}), 8) AS value FROM {L} GROUP BY 1")(lambda s, d, g=_g: _group_prod(s, d, g))


def _group_prod(s: SparkSession, d: str, group: str) -> DataFrame:
    c = Coverage.of(lines(s, d).df.select("time", "station", F.expr(_FACTOR).alias("value")), ["time", "station"])
    return shown(reduce.group_reduce(reduce_all_stations(c), group, "prod"), 8)


def reduce_all_stations(c: Coverage) -> Coverage:
    """The samples of all stations as samples of time alone."""
    return c.with_df(c.df.drop("station"), dims=["time"])


_query("group_month_by_station", f"SELECT month(time)::BIGINT AS time, station, round(median(value), 4) AS value FROM {L} GROUP BY 1, 2")(lambda s, d: shown(reduce.group_reduce(lines(s, d).select("value"), "month", "median")))
_query("resample_daily", f"SELECT epoch_us(date_trunc('day', time)::TIMESTAMP) AS time, round(avg(value), 7) AS value FROM {E_} GROUP BY 1")(lambda s, d: shown(reduce.resample(reduce_all_stations(events(s, d)), "1,D", "mean", spine=False), 7))
_query("resample_weekly", f"SELECT epoch_us(date_trunc('week', time)::TIMESTAMP) AS time, station, round(sum(value), 4) AS value FROM {E_} GROUP BY 1, 2")(lambda s, d: shown(reduce.resample(events(s, d), "1,W", "sum", spine=False)))
_query("resample_monthly", f"SELECT epoch_us(date_trunc('month', time)::TIMESTAMP) AS time, round(stddev_pop(value), 4) AS value FROM {L} GROUP BY 1")(lambda s, d: shown(reduce.resample(reduce_all_stations(lines(s, d).select("value")), "1,M", "std", spine=False)))
for _fn, _sql in (("sum", "coalesce(sum(value), 0)"), ("mean", "avg(value)")):
    _query(
        f"resample_hourly_spine_{_fn}",
        f"WITH e AS (SELECT date_trunc('hour', time)::TIMESTAMP AS h, value FROM {E_}), s AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM e) SELECT epoch_us(s.h) AS time, round({_sql}, {_places(_fn)}) AS value FROM s LEFT JOIN e USING (h) GROUP BY s.h",
    )(lambda s, d, fn=_fn: shown(reduce.resample(reduce_all_stations(events(s, d)), "1,h", fn), _places(fn)))
_DOY = f"(SELECT least(dayofyear(time), 365) AS day, value FROM {L})"
_DOY_JOIN = f"FROM (SELECT DISTINCT dayofyear(time) AS time FROM {L}) w JOIN {_DOY} x ON least((x.day - least(w.time, 365) + 365) % 365, (least(w.time, 365) - x.day + 365) % 365) <= {{half}} GROUP BY 1"
_query("doy_window3_mean", f"SELECT w.time::BIGINT AS time, round(avg(value), 7) AS value {_DOY_JOIN.format(half=1)}")(lambda s, d: shown(reduce.day_of_year_window(reduce_all_stations(lines(s, d).select("value")), 3, "mean"), 7))
_query("doy_window5_count", f"SELECT w.time::BIGINT AS time, count(value)::DOUBLE AS value {_DOY_JOIN.format(half=2)}")(lambda s, d: shown(reduce.day_of_year_window(reduce_all_stations(lines(s, d).select("value")), 5, "count")))
# (times pi, so that no mean ends in a five)
_query("doy_window_scaled", f"SELECT w.time::BIGINT AS time, round((avg(CASE WHEN value BETWEEN 1000 AND 90000 THEN (value - 1000) / 89000 END) * 89000 + 1000) * pi(), 5) AS value {_DOY_JOIN.format(half=3)}")(
    lambda s, d: shown(reduce.day_of_year_window(reduce_all_stations(lines(s, d).select("value")), 7, "mean", scale_float=(1000, 90000), rescale=True).mapped(lambda v: v * F.pi()), 5)
)

_query("beta_fit_by_day")(lambda s, d: shown(climatology.beta_fit(reduce_all_stations(lines(s, d).select("value")), 31, [0.1, 0.9], scale_float=(0.0, 110000.0))))
_query("doy_window9_max", f"SELECT w.time::BIGINT AS time, round(max(value), 4) AS value {_DOY_JOIN.format(half=4)}")(lambda s, d: shown(reduce.day_of_year_window(reduce_all_stations(lines(s, d).select("value")), 9, "max")))
_query("doy_window3_median", f"SELECT w.time::BIGINT AS time, round(median(value), 4) AS value {_DOY_JOIN.format(half=1)}")(lambda s, d: shown(reduce.day_of_year_window(reduce_all_stations(lines(s, d).select("value")), 3, "median")))
_STATION_ENDS = f"(SELECT station, min(value) AS lo, max(value) + 1 AS hi FROM {L} GROUP BY 1)"
_query(
    "doy_window_scaled_by_station",
    f"WITH x AS (SELECT l.station, least(dayofyear(time), 365) AS day, (value - lo) / (hi - lo) AS v FROM {L} l JOIN {_STATION_ENDS} e ON e.station = l.station) SELECT w.time::BIGINT AS time, x.station, round((avg(v) * (hi - lo) + lo) * pi(), 5) AS value FROM (SELECT DISTINCT dayofyear(time) AS time FROM {L}) w JOIN x ON least((x.day - least(w.time, 365) + 365) % 365, (least(w.time, 365) - x.day + 365) % 365) <= 1 JOIN {_STATION_ENDS} e ON e.station = x.station GROUP BY 1, 2, hi, lo",
)(lambda s, d: _scaled_by_station(s, d))


def _scaled_by_station(s: SparkSession, d: str) -> DataFrame:
    c = lines(s, d).select("value")
    low, high = reduce.reduce(c, "min", ["time"]), reduce.reduce(c, "max", ["time"]).mapped(lambda v: v + 1)
    return shown(reduce.day_of_year_window(c, 3, "mean", scale_float=(low, high), rescale=True).mapped(lambda v: v * F.pi()), 5)


# -- time transforms (M4, C21) and rewrites (M1-M3) --------------------------------------------------
_PARTS = {
    "day": "day(time)", "dayofweek": "isodow(time) - 1", "dayofyear": "dayofyear(time)", "daysinmonth": "day(last_day(time))", "month": "month(time)", "quarter": "quarter(time)", "year": "year(time)",
    "weekofyear": "week(time)", "minute": "minute(time)", "second": "second(time)", "microsecond": "microsecond(time) % 1000000", "nanosecond": "0",
}
for _u, _sql in _PARTS.items():
    _query(f"time_transform_{_u}", f"SELECT ({_sql})::BIGINT AS time, count(*) AS n FROM {E_} GROUP BY 1")(lambda s, d, u=_u: rewrite.transform_time(reduce_all_stations(events(s, d)), u).df.groupBy("time").agg(F.count("*").alias("n")))
_query("time_transform_season", f"SELECT ['DJF', 'MAM', 'JJA', 'SON'][(month(time) % 12) // 3 + 1] AS time, count(*) AS n FROM {L} GROUP BY 1")(lambda s, d: rewrite.transform_time(lines(s, d), "season").df.groupBy("time").agg(F.count("*").alias("n")))
_query("time_transform_weekday_name", f"SELECT dayname(time) AS time, count(*) AS n FROM {L} GROUP BY 1")(lambda s, d: rewrite.transform_time(lines(s, d), "weekday_name").df.groupBy("time").agg(F.count("*").alias("n")))
_query("time_transform_time", f"SELECT strftime(time, '%H:%M:%S') AS time, count(*) AS n FROM {E_} GROUP BY 1")(lambda s, d: rewrite.transform_time(events(s, d), "time").df.groupBy("time").agg(F.count("*").alias("n")))
_query("select_time", f"SELECT epoch_us(time) AS time, station, round(value, 4) AS value FROM {E_} WHERE time >= '2024-01-10' AND time <= '2024-01-12 12:00:00'")(lambda s, d: shown(rewrite.select(events(s, d), "time", ["2024-01-10", "2024-01-12T12:00:00"])))
_REQ_DAYS = Coordinates([UniformAxis("2024-01-03", "2024-01-28", "5,D", name="time")])
_REQ_DAYS_SQL = "(SELECT TIMESTAMP '2024-01-03' + to_days((i * 5)::INT) AS t FROM range(6) r(i))"
_query("expand_time", f"SELECT epoch_us(t) AS request_time, count(*) AS n, round(avg(value), 7) AS value FROM {_REQ_DAYS_SQL} JOIN {E_} ON time >= t - INTERVAL 3 DAY AND time <= t + INTERVAL 4 DAY GROUP BY 1")(
    lambda s, d: rewrite.expand(events(s, d), _REQ_DAYS.frame(s), "time", "-3,D", "4,D").df.groupBy(F.unix_micros("request_time").alias("request_time")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 7).alias("value"))
)
_query("year_substitute", f"SELECT epoch_us(time + to_months(((2000 - year(time)) * 12)::INT)) AS time, count(*) AS n FROM {L} GROUP BY 1")(
    lambda s, d: rewrite.year_substitute(lines(s, d).df.select("time"), 2000).groupBy(F.unix_micros("time").alias("time")).agg(F.count("*").alias("n"))
)

# -- nearest (I3-I6, I11) --------------------------------------------------------------------------
_FINE = UniformAxis(-1.5, 52, 0.5, name="size")
_FINE_SQL = "(SELECT -1.5 + i * 0.5 AS size FROM range(108) r(i))"


def _nearest(**options: object) -> Query:
    return lambda s, d: shown(interpolate.nearest_uniform(sizes(s, d), _FINE.frame(s), "size", SIZE, **options))


for _name, _opts, _index, _keep in (
    ("uniform", {}, "ceil(r.size - 1 - 0.5)", "k BETWEEN 0 AND 49"),
    ("half_up", {"ties": "+infinity"}, "floor(r.size - 1 + 0.5)", "k BETWEEN 0 AND 49"),
    ("half_even", {"ties": "unbiased"}, "round_even(r.size - 1, 0)", "k BETWEEN 0 AND 49"),
    ("tolerance", {"tolerance": 0.2}, "ceil(r.size - 1 - 0.5)", "k BETWEEN 0 AND 49 AND abs(size - 1 - k) <= 0.2"),
    ("clip", {"respect_bounds": False}, "greatest(0, least(49, ceil(r.size - 1 - 0.5)))", "true"),
):
    _query(f"nearest_{_name}", f"SELECT q.size, round(p.value, 4) AS value FROM (SELECT size, CASE WHEN {_keep} THEN k END AS k FROM (SELECT r.size, {_index} AS k FROM {_FINE_SQL} r)) q LEFT JOIN {P} p ON p.size = q.k + 1")(_nearest(**_opts))
_IRREGULAR = Axis([1, 2, 4, 7, 11, 16, 22, 29, 37, 46], "size")
_query("nearest_irregular", f"SELECT r.size, (SELECT round(arg_min(value, [abs(p.size - r.size), p.size]), 4) FROM {P} p WHERE p.size IN (1, 2, 4, 7, 11, 16, 22, 29, 37, 46) AND r.size BETWEEN 1 AND 46) AS value FROM {_FINE_SQL} r")(
    lambda s, d: shown(interpolate.nearest_irregular(_some_sizes(s, d), _FINE.frame(s), "size", _IRREGULAR))
)


def _some_sizes(s: SparkSession, d: str) -> Coverage:
    c = sizes(s, d)
    return c.with_df(c.df.where(F.col("size").isin(*(float(v) for v in _IRREGULAR.coordinates))))


_POINTS = "(SELECT (i * 37 % 190) / 10.0 AS lat, (i * 53 % 240) / 10.0 AS lon FROM range(60) r(i))"
_query("nearest_2d_points", f"SELECT q.lat::DOUBLE AS lat, q.lon::DOUBLE AS lon, (SELECT round(arg_min(value, [round(sqrt(pow(g.lat - q.lat, 2) + pow(g.lon - q.lon, 2)), 9), g.lat, g.lon]), 4) FROM {G} g WHERE sqrt(pow(g.lat - q.lat, 2) + pow(g.lon - q.lon, 2)) <= 0.6) AS value FROM {_POINTS} q")(
    lambda s, d: shown(interpolate.nearest_points(grid(s, d), _points(s), ["lat", "lon"], cell=1.0, reach=0.6))
)


def _points(s: SparkSession) -> DataFrame:
    i = F.col("id")
    return s.range(60).select(((i * 37) % 190 / 10.0).alias("lat"), ((i * 53) % 240 / 10.0).alias("lon"))


for _dir, _asof in (("previous", "time <= t ORDER BY time DESC"), ("next", "time >= t ORDER BY time")):
    _query(f"asof_{_dir}", f"SELECT station, epoch_us(t) AS time, round((SELECT value FROM (SELECT station AS s2, time, value FROM (SELECT time, station, avg(value) AS value FROM {E_} GROUP BY ALL)) WHERE s2 = q.station AND {_asof} LIMIT 1), 4) AS value FROM (SELECT DISTINCT station FROM {E_}) q, {_REQ_DAYS_SQL}")(
        lambda s, d, direction=_dir: shown(_as_of(s, d, direction))
    )


def _as_of(s: SparkSession, d: str, direction: str) -> Coverage:
    c = events(s, d)
    cells = c.with_df(c.df.groupBy("time", "station").agg(F.avg("value").alias("value")))
    request = c.df.select("station").distinct().crossJoin(F.broadcast(_REQ_DAYS.frame(s, index=False)))
    return interpolate.as_of(cells, request, "time", direction)


# -- linear (I8, I10), gaps, area (I9) ---------------------------------------------------------------
_LIN = UniformAxis(0.25, 55, 0.75, name="size")
_LIN_SQL = "(SELECT 0.25 + i * 0.75 AS size FROM range(74) r(i))"
_query(
    "linear_1d",
    f"SELECT q.size, round(a.value * (1 - (q.size - 1 - lo)) + b.value * (q.size - 1 - lo), 4) AS value FROM (SELECT size, CASE WHEN size BETWEEN 1 AND 50 THEN least(greatest(ceil(size - 1) - 1, 0), 48) END AS lo FROM {_LIN_SQL}) q LEFT JOIN {P} a ON a.size = lo + 1 LEFT JOIN {P} b ON b.size = lo + 2",
)(lambda s, d: shown(interpolate.linear(sizes(s, d), _LIN.frame(s), "size", SIZE)))
_query(
    "linear_extrapolate",
    f"SELECT q.size, round(a.value * (1 - (q.size - 1 - lo)) + b.value * (q.size - 1 - lo), 4) AS value FROM (SELECT size, least(greatest(ceil(size - 1) - 1, 0), 48) AS lo FROM {_LIN_SQL}) q LEFT JOIN {P} a ON a.size = lo + 1 LEFT JOIN {P} b ON b.size = lo + 2",
)(lambda s, d: shown(interpolate.linear(sizes(s, d), _LIN.frame(s), "size", SIZE, extrapolate=True)))
_TARGET = Coordinates.grid(lat=(-0.5, 19.5, 17), lon=(0, 24, 13))
_TARGET_SQL = "(SELECT -0.5 + a.i * 1.25 AS lat, b.i * 2.0 AS lon FROM range(17) a(i), range(13) b(i))"
_query(
    "bilinear_2d",
    f"""SELECT q.lat::DOUBLE AS lat, q.lon::DOUBLE AS lon, round(CASE WHEN count(g.value) = 4 THEN sum(g.value * wa * wb) END, 4) AS value FROM (
  SELECT lat, lon, la + da AS a, lb + db AS b, CASE WHEN da = 1 THEN lat - la ELSE 1 - (lat - la) END AS wa, CASE WHEN db = 1 THEN lon - lb ELSE 1 - (lon - lb) END AS wb FROM (
    SELECT lat, lon, CASE WHEN lat BETWEEN 0 AND 19 THEN least(greatest(ceil(lat) - 1, 0), 18) END AS la, CASE WHEN lon BETWEEN 0 AND 24 THEN least(greatest(ceil(lon) - 1, 0), 23) END AS lb FROM {_TARGET_SQL}),
    (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(da, db)) q LEFT JOIN {GAPS} g ON g.lat = q.a AND g.lon = q.b GROUP BY 1, 2""",
)(lambda s, d: shown(interpolate.bilinear(grid(s, d, gaps=True), _TARGET.frame(s), "lat", "lon", LAT, LON)))
_query("fill_nan", f"WITH p AS (SELECT size, CASE WHEN size % 4 NOT IN (2, 3) THEN value END AS v FROM {P}) SELECT size, round(coalesce(v, (SELECT a.v + (b.v - a.v) * (p.size - a.size) / (b.size - a.size) FROM (SELECT size, v FROM p x WHERE x.size < p.size AND v IS NOT NULL ORDER BY size DESC LIMIT 1) a, (SELECT size, v FROM p y WHERE y.size > p.size AND v IS NOT NULL ORDER BY size LIMIT 1) b)), 4) AS value FROM p")(
    lambda s, d: shown(interpolate.fill_missing(sizes(s, d).mapped(lambda v: F.when(~(F.col("size") % 4).isin(2.0, 3.0), v)), "size"))
)
_COARSE = {"lat": (LAT, UniformAxis(1.5, 17.5, size=5, name="lat")), "lon": (LON, UniformAxis(2, 22, size=5, name="lon"))}
for _m, _sql in {"average": "avg(value)", "max": "max(value)", "min": "min(value)", "med": "median(value)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)", "sum": "sum(value)"}.items():
    _query(f"resample_{_m}", f"SELECT 1.5 + floor(lat / 4) * 4 AS lat, 2 + floor(lon / 5) * 5 AS lon, round({_sql}, 4) AS value FROM {G} GROUP BY 1, 2")(lambda s, d, m=_m: shown(interpolate.area_resample(grid(s, d), m, _COARSE)))
_query("resample_mode", f"SELECT 1.5 + floor(lat / 4) * 4 AS lat, 2 + floor(lon / 5) * 5 AS lon, arg_min(v, [-n::DOUBLE, v]) AS value FROM (SELECT lat, lon, v, count(*) OVER (PARTITION BY floor(lat / 4), floor(lon / 5), v) AS n FROM (SELECT lat, lon, floor(value / 5000) AS v FROM {G})) GROUP BY 1, 2")(
    lambda s, d: shown(interpolate.area_resample(grid(s, d).mapped(lambda v: F.floor(v / 5000).cast("double")), "mode", _COARSE))
)

# -- composition (O0-O3) -----------------------------------------------------------------------------
def _parts(s: SparkSession, d: str) -> list[Coverage]:
    c = grid(s, d, gaps=True)
    where = lambda cond, k: c.with_df(c.df.where(cond)).mapped(lambda v: v + k)
    return [where("lat < 8", 0), where("lat >= 4 and lat < 15", 1_000_000), where("lon > 10", 2_000_000)]


_PARTS_SQL = f"(SELECT lat, lon, value, 0 AS p FROM {GAPS} WHERE lat < 8 UNION ALL SELECT lat, lon, value + 1000000, 1 FROM {GAPS} WHERE lat >= 4 AND lat < 15 UNION ALL SELECT lat, lon, value + 2000000, 2 FROM {GAPS} WHERE lon > 10)"
_query("composite_tile", f"SELECT lat, lon, round(arg_min(value, CASE WHEN value IS NOT NULL THEN p END), 3) AS value FROM {_PARTS_SQL} GROUP BY 1, 2")(lambda s, d: shown(composite.tile(_parts(s, d)), 3))
_REQ_ALL_SQL = "(SELECT a.i::DOUBLE AS lat, b.i::DOUBLE AS lon FROM range(22) a(i), range(27) b(i))"
_query("composite_ordered", f"SELECT r.lat, r.lon, round(arg_min(value, CASE WHEN value IS NOT NULL THEN p END), 3) AS value, min(CASE WHEN value IS NOT NULL THEN p END)::DOUBLE AS source_index FROM {_REQ_ALL_SQL} r LEFT JOIN {_PARTS_SQL} x ON x.lat = r.lat AND x.lon = r.lon GROUP BY 1, 2")(
    lambda s, d: shown(composite.ordered(_parts(s, d), Coordinates.grid(lat=(0, 21, 22), lon=(0, 26, 27)).frame(s), with_index=True), 3)
)
_query("composite_pruned", f"SELECT lat, lon, round(arg_min(value, CASE WHEN value IS NOT NULL THEN p END), 3) AS value FROM {_PARTS_SQL} WHERE p >= 1 GROUP BY 1, 2")(lambda s, d: shown(composite.tile(composite.pruned(list(zip((0.0, 5.0, 10.0), _parts(s, d), strict=True)), 1.0, 12.0)), 3))

# -- convolution (W1-W3) --------------------------------------------------------------------------
_query("convolve_1d", f"SELECT size, round(sum(CASE o WHEN -1 THEN 1 WHEN 0 THEN 2 ELSE 4 END * v), 4) AS value FROM (SELECT p.size, o, x.value AS v FROM {P} p, (VALUES (-1), (0), (1)) k(o) JOIN {P} x ON true WHERE x.size = p.size - o) GROUP BY 1")(
    lambda s, d: shown(convolve.convolve(sizes(s, d), [1, 2, 4], {"size": SIZE}))
)
_query("convolve_2d_mean3", f"SELECT p.lat, p.lon, round(CASE WHEN count(*) = count(x.value) THEN sum(x.value / 9) END, 4) AS value FROM {GAPS} p JOIN {GAPS} x ON abs(x.lat - p.lat) <= 1 AND abs(x.lon - p.lon) <= 1 GROUP BY 1, 2")(
    lambda s, d: shown(convolve.convolve(grid(s, d, gaps=True), convolve.kernel("mean,3", 2), {"lat": LAT, "lon": LON}))
)
_query("convolve_by_lags", f"SELECT lat, lon, round(sum(CASE o WHEN 0 THEN 0.5 ELSE 0.25 END * v), 4) AS value FROM (SELECT p.lat, p.lon, o, x.value AS v FROM {G} p, (VALUES (-1), (0), (1)) k(o) JOIN {G} x ON true WHERE x.lat = p.lat AND x.lon = p.lon - o) GROUP BY 1, 2")(
    lambda s, d: shown(convolve.convolve_1d(grid(s, d), [0.25, 0.5, 0.25], "lon"))
)
_query("cumsum", f"SELECT lat, lon, round(CASE WHEN value IS NOT NULL THEN sum(value) OVER (PARTITION BY lat ORDER BY lon) END, 4) AS value FROM {GAPS}")(lambda s, d: shown(algebra.cumulative(grid(s, d, gaps=True), "lon")))

_query("cumsum_one_dimension", f"SELECT size, round(sum(value) OVER (ORDER BY size), 4) AS value FROM {P}")(lambda s, d: shown(algebra.cumulative(sizes(s, d), "size")))
for _dir, _asof in (("previous", "p.size <= q.size ORDER BY p.size DESC"), ("next", "p.size >= q.size ORDER BY p.size")):
    _query(f"asof_{_dir}_one_dimension", f"SELECT q.size, round((SELECT value FROM {P} p WHERE p.size % 7 < 3 AND {_asof} LIMIT 1), 4) AS value FROM {_FINE_SQL} q")(
        lambda s, d, m=_dir: shown(interpolate.as_of(sizes(s, d).mapped(lambda v: F.when(F.col("size") % 7 < 3, v)), _FINE.frame(s), "size", m))
    )

# -- CRS and distance (C20, C22, C23), reprojection (M5), caches (J12) -------------------------------
_query("mercator", f"SELECT round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) + 0.0 AS lat, round(6378137 * radians(lon), 4) AS lon, round(value, 4) AS value FROM {G}")(lambda s, d: _mercator(grid(s, d)))
_query("haversine", f"SELECT lat, lon, round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 5) / 2), 2)))), 4) AS value FROM {G}")(
    lambda s, d: shown(grid(s, d).mapped(lambda v: crs.haversine(F.lit(10.0), F.lit(5.0), F.col("lat"), F.col("lon")) / 1000))
)
_query("reproject_grid", f"SELECT q.lat, q.lon, round(CASE WHEN count(g.value) = 4 THEN sum(g.value * wa * wb) END, 7) AS value FROM (SELECT lat, lon, la + da * 4 AS a, lb + db * 4 AS b, CASE WHEN da = 1 THEN (lat - la) / 4 ELSE 1 - (lat - la) / 4 END AS wa, CASE WHEN db = 1 THEN (lon - lb) / 4 ELSE 1 - (lon - lb) / 4 END AS wb FROM (SELECT lat, lon, least(greatest(ceil(lat / 4) - 1, 0), 3) * 4 AS la, least(greatest(ceil(lon / 4) - 1, 0), 5) * 4 AS lb FROM (SELECT a.i::DOUBLE AS lat, b.i::DOUBLE AS lon FROM range(17) a(i), range(25) b(i))), (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(da, db)) q LEFT JOIN {G} g ON g.lat = q.a AND g.lon = q.b GROUP BY 1, 2")(
    lambda s, d: shown(_reprojected(s, d), 7)
)
_query("partial_cache_missing", f"SELECT lat, lon FROM {_REQ_ALL_SQL} EXCEPT SELECT lat, lon FROM {GAPS} WHERE value IS NOT NULL")(
    lambda s, d: Coordinates.grid(lat=(0, 21, 22), lon=(0, 26, 27)).frame(s, index=False).join(grid(s, d, gaps=True).df.where("value is not null"), ["lat", "lon"], "left_anti")
)


def _mercator(c: Coverage) -> DataFrame:
    y, x = crs.transform(F.col("lat"), F.col("lon"), crs.DEFAULT, "EPSG:3857")
    return c.df.select((F.round(y, 4) + 0.0).alias("lat"), F.round(x, 4).alias("lon"), F.round("value", 4).alias("value"))


def _reprojected(s: SparkSession, d: str) -> Coverage:
    """Every fourth cell first, then bilinear to all."""
    lat, lon = UniformAxis(0, 16, size=5, name="lat"), UniformAxis(0, 24, size=7, name="lon")
    coarse = interpolate.nearest_uniform(grid(s, d), Coordinates([lat, lon]).frame(s), "lat", LAT)
    return interpolate.bilinear(coarse, Coordinates.grid(lat=(0, 16, 17), lon=(0, 24, 25)).frame(s), "lat", "lon", lat, lon)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean per station on a uniform hourly grid, hours without data taken from the nearest hour
    within six hours."""
    c = events(spark, sf_dir)
    hourly = reduce.resample(c, "1,h", "mean", spine=False)
    ends = c.df.agg(F.date_trunc("day", F.min("time")).alias("lo"), F.max("time").alias("hi"))
    days = ends.where("lo is not null").select(F.explode(F.sequence("lo", F.date_trunc("day", "hi"), F.expr("interval 1 day"))).alias("time"))
    filled = interpolate.carried_cells(hourly, "time", "1,h", 6 * 3600, ends)
    daily = filled.df.groupBy("station", F.date_trunc("day", "time").alias("time")).agg(F.avg("value").alias("value"), F.count("value").cast("double").alias("hours"))
    # the product of stations and days is the result itself
    dense = c.df.select("station").distinct().crossJoin(F.broadcast(days)).join(daily, ["station", "time"], "left")
    return shown(Coverage(dense.withColumn("hours", F.coalesce("hours", F.lit(0.0))), ("station", "time"), ("value", "hours")), 7)


_query(
    "hourly_fill_daily_mean",
    f"""WITH h AS (SELECT station, date_trunc('hour', time)::TIMESTAMP AS time, avg(value) AS v FROM {E_} GROUP BY ALL),
  hours AS (SELECT unnest(generate_series(date_trunc('day', min(time))::TIMESTAMP, max(time), INTERVAL 1 HOUR)) AS time FROM {E_}),
  g AS (SELECT s.station, o.time, v, CASE WHEN v IS NOT NULL THEN o.time END AS known FROM (SELECT DISTINCT station FROM h) s CROSS JOIN hours o LEFT JOIN h ON h.station = s.station AND h.time = o.time),
  f AS (SELECT station, time, last_value(v IGNORE NULLS) OVER p AS a, last_value(known IGNORE NULLS) OVER p AS seen, first_value(v IGNORE NULLS) OVER n AS b, first_value(known IGNORE NULLS) OVER n AS bt FROM g
    WINDOW p AS (PARTITION BY station ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY station ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  x AS (SELECT station, time, CASE WHEN time - seen <= INTERVAL 6 HOUR THEN a WHEN bt - time <= INTERVAL 6 HOUR THEN b END AS v FROM f)
SELECT station, epoch_us(date_trunc('day', time)::TIMESTAMP) AS time, round(avg(v), 7) AS value, count(v)::DOUBLE AS hours FROM x GROUP BY 1, 2""",
)(flagship)


# -- nodes (I0-I14, M5, O1, O2, H1, H2, G3, S3, S4): what users call, over tables whose coordinates nobody declares ------
def _table(s: SparkSession, d: str, name: str) -> Node:
    """A view as a source node."""
    c = {"sizes": sizes, "grid": grid, "gaps": lambda s, d: grid(s, d, gaps=True), "events": lambda s, d: _event_means(s, d)}[name](s, d)
    return Table(table=c.df, dims=list(c.dims), data="value")


def _event_means(s: SparkSession, d: str) -> Coverage:
    c = events(s, d)
    return c.with_df(c.df.groupBy("time", "station").agg(F.avg("value").alias("value")))


def _some(s: SparkSession, d: str) -> Node:
    """Part sizes that are squares or twice squares: an irregular axis that nobody declares."""
    c = sizes(s, d)
    square = lambda v: F.sqrt(v) == F.floor(F.sqrt(v))
    return Table(table=c.df.where(square(F.col("size")) | square(F.col("size") / 2)), dims=["size"], data="value")


_SOME = f"(SELECT * FROM {P} WHERE sqrt(size) = floor(sqrt(size)) OR sqrt(size / 2) = floor(sqrt(size / 2)))"
_ASKED = Coordinates([UniformAxis(0.25, 55, 0.75, name="size")])
_ASKED_SQL = "(SELECT 0.25 + i * 0.75 AS size FROM range(74) r(i))"
_LOW, _HIGH = f"(SELECT max(p.size) FROM {_SOME} p WHERE p.size <= q.size)", f"(SELECT min(p.size) FROM {_SOME} p WHERE p.size >= q.size)"
_NEAR = f"(SELECT q.size, {_LOW} AS lo, {_HIGH} AS hi FROM {_ASKED_SQL} q)"
_AT = lambda k: f"(SELECT value FROM {_SOME} p WHERE p.size = {k})"
for _name, _method, _sql in (
    ("nearest", "nearest", f"CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CASE WHEN n.size - lo <= hi - n.size THEN {_AT('n.lo')} ELSE {_AT('n.hi')} END END"),
    ("linear", "linear", f"CASE WHEN lo = hi THEN {_AT('n.lo')} ELSE {_AT('n.lo')} * (1 - (n.size - lo) / (hi - lo)) + {_AT('n.hi')} * (n.size - lo) / (hi - lo) END"),
    ("previous", "previous", _AT("n.lo")),
    ("next", "next", _AT("n.hi")),
):
    _query(f"node_{_name}_table", f"SELECT n.size, round({_sql}, 7) AS value FROM {_NEAR} n")(lambda s, d, m=_method: shown(_some(s, d).interpolate(m).eval(_ASKED, s), 7))
for _name, _at in (("inside", 5.6), ("on_a_cell", 8.0), ("outside", 60.0)):
    _query(f"node_point_{_name}", f"SELECT q.size::DOUBLE AS size, round((SELECT arg_min(value, [abs(p.size - q.size), p.size]) FROM {P} p WHERE q.size <= 50.5), 4) AS value FROM (VALUES ({_at})) q(size)")(
        lambda s, d, at=_at: shown(_table(s, d, "sizes").interpolate("nearest").eval(Coordinates([[at]], dims=["size"]), s))
    )
_MANY = Coordinates([UniformAxis(1, 43, size=1_050_001, name="size")])
_query("node_million_values", f"SELECT count(*) AS n, count(value) AS known, round(sum(value)) AS total, min(size) AS least, max(size) AS most FROM (SELECT size, value FROM (SELECT 1 + i * 0.00004 AS size FROM range(1050001) r(i)) q ASOF LEFT JOIN (SELECT size AS at, value FROM {P}) p ON q.size >= p.at)")(
    lambda s, d: _totals(_table(s, d, "sizes").interpolate("previous").eval(_MANY, s).df)
)


def _totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count("value").alias("known"), F.round(F.sum("value")).alias("total"), F.min("size").alias("least"), F.max("size").alias("most"))


_query("node_every_second_cell", f"SELECT size, round(value, 4) AS value FROM {P} WHERE size % 2 = 1")(
    lambda s, d: shown(_table(s, d, "sizes").interpolate("nearest").eval(Coordinates([UniformAxis(1, 49, 2.0, name="size")]), s))
)
for _dir, _asof in (("previous", "time <= t ORDER BY time DESC"), ("next", "time >= t ORDER BY time")):
    _query(f"node_{_dir}_by_station", f"SELECT station::DOUBLE AS station, epoch_us(t) AS time, round((SELECT value FROM (SELECT station AS s2, time, avg(value) AS value FROM {E_} GROUP BY ALL) WHERE s2 = q.station AND {_asof} LIMIT 1), 4) AS value FROM (SELECT DISTINCT station FROM {E_} WHERE station BETWEEN 3 AND 9) q, {_REQ_DAYS_SQL}")(
        lambda s, d, m=_dir: shown(_by_station(s, d, m))
    )


def _by_station(s: SparkSession, d: str, method: str) -> Coverage:
    c = _event_means(s, d)
    c = c.with_df(c.df.withColumn("station", F.col("station").cast("double")).where("station between 3 and 9"))
    ask = Coordinates([UniformAxis("2024-01-03", "2024-01-28", "5,D", name="time"), Axis([3.0, 9.0], "station")])
    node = Table(table=c.df, dims=["time", "station"], data="value")
    out = node.interpolate([{"method": method, "dims": ["time"]}, {"method": "none", "dims": ["station"]}]).eval(ask, s)
    return out


_query("node_bilinear_table", ORACLE["bilinear_2d"])(lambda s, d: shown(_table(s, d, "gaps").interpolate("bilinear").eval(_TARGET, s)))
_query("node_reproject", ORACLE["reproject_grid"])(
    lambda s, d: shown(Reproject(source=_table(s, d, "grid"), coordinates=Coordinates.grid(lat=(0, 16, 5), lon=(0, 24, 7)), interpolation="bilinear").eval(Coordinates.grid(lat=(0, 16, 17), lon=(0, 24, 25)), s), 7)
)
_WHOLE = Coordinates.grid(lat=(0, 21, 22), lon=(0, 26, 27))


def _part_nodes(s: SparkSession, d: str) -> list[Node]:
    return [Table(table=c.df, dims=["lat", "lon"], data="value") for c in _parts(s, d)]


_query("node_ordered_compositor", f"SELECT r.lat, r.lon, round(arg_min(value, CASE WHEN value IS NOT NULL THEN p END), 3) AS value FROM {_REQ_ALL_SQL} r LEFT JOIN {_PARTS_SQL} x ON x.lat = r.lat AND x.lon = r.lon GROUP BY 1, 2")(
    lambda s, d: shown(OrderedCompositor(sources=_part_nodes(s, d)).eval(_WHOLE, s), 3)
)
_query("node_tile_compositor", ORACLE["composite_tile"])(lambda s, d: shown(TileCompositor(sources=_part_nodes(s, d)).eval(_WHOLE, s), 3))
_query("node_arithmetic", f"SELECT lat, lon, round(value * 2 + lat, 3) AS value FROM {GAPS} WHERE lat BETWEEN 2 AND 9")(
    lambda s, d: shown(Arithmetic(eqn="a * 2 + b", a=_table(s, d, "gaps"), b=_lat_table(s, d)).eval(Coordinates.grid(lat=(2, 9, 8), lon=(0, 24, 25)), s), 3)
)


def _lat_table(s: SparkSession, d: str) -> Node:
    c = grid(s, d).mapped(lambda v: F.col("lat"))
    return Table(table=c.df, dims=["lat", "lon"], data="value")


_query("node_mean", f"SELECT lat, round(avg(value), 7) AS value FROM {GAPS} GROUP BY 1")(lambda s, d: shown(Mean(source=_table(s, d, "gaps"), dims=["lon"]).eval(Coordinates.grid(lat=(0, 19, 20), lon=(0, 24, 25)), s), 7))
_query("node_array", "SELECT a.i::DOUBLE AS lat, (b.i * 2)::DOUBLE AS lon, (a.i * 3 + b.i)::DOUBLE AS value FROM range(4) a(i), range(3) b(i)")(
    lambda s, d: shown(Array(source=[[3 * i + j for j in range(3)] for i in range(4)], coordinates=Coordinates.grid(lat=(0, 3, 4), lon=(0, 4, 3))).eval(Coordinates.grid(lat=(0, 3, 4), lon=(0, 4, 3)), s))
)
_query("node_preview", f"SELECT q.size::DOUBLE AS size, round(p.value, 4) AS value FROM (SELECT 1 + i * 7 AS size FROM range(8) r(i)) q LEFT JOIN {P} p ON p.size = q.size")(
    lambda s, d: shown(_table(s, d, "sizes").interpolate("nearest_preview").eval(Coordinates([UniformAxis(1, 50, size=8, name="size")]), s))
)
_query("gauss", f"SELECT t.i * 5.0 + 3 AS size, round(sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END), 4) AS value FROM (SELECT t.i, value, exp(-2 * pow((size - 3) / 5 - t.i, 2)) AS w FROM {P}, range(10) t(i) WHERE abs(round_even((size - 3) / 5, 0) - t.i) <= 1) t GROUP BY 1")(
    lambda s, d: shown(interpolate.area_resample(sizes(s, d), "gauss", {"size": (SIZE, UniformAxis(3, 48, size=10, name="size"))}))
)
_query("lanczos", f"SELECT size, round(sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END), 4) AS value FROM (SELECT q.size, p.value, CASE WHEN abs(q.size - p.size) < 1e-9 THEN 1.0 ELSE sin(pi() * (q.size - p.size)) / (pi() * (q.size - p.size)) * sin(pi() * (q.size - p.size) / 3) / (pi() * (q.size - p.size) / 3) END AS w FROM (SELECT 1.25 + i * 0.75 AS size FROM range(65) r(i)) q LEFT JOIN {P} p ON abs(p.size - q.size) < 3) GROUP BY 1")(
    lambda s, d: shown(interpolate.lanczos(sizes(s, d), UniformAxis(1.25, 49.25, 0.75, name="size").frame(s), "size", SIZE))
)
_query("hash_cache", f"SELECT lat, lon, round(value, 3) AS value FROM {GAPS}")(lambda s, d: shown(_twice(HashCache(source=_table(s, d, "gaps"), path=_scratch(s)), s, Coordinates.grid(lat=(0, 19, 20), lon=(0, 24, 25))), 3))
_query("partial_cache", f"SELECT r.lat, r.lon, round(value, 3) AS value FROM {_REQ_ALL_SQL} r LEFT JOIN {GAPS} g ON g.lat = r.lat AND g.lon = r.lon")(
    lambda s, d: shown(_grown(PartialCache(source=_table(s, d, "gaps"), path=_scratch(s)), s), 3)
)
_query("parallel_output", f"SELECT r.lat, r.lon, round(value, 3) AS value FROM {_REQ_ALL_SQL} r LEFT JOIN {G} g ON g.lat = r.lat AND g.lon = r.lon WHERE r.lat < 20 AND r.lon < 25")(lambda s, d: shown(_twice(ParallelOutput(source=_table(s, d, "grid"), path=_scratch(s), chunks={"lat": 7, "lon": 10}), s, Coordinates.grid(lat=(0, 19, 20), lon=(0, 24, 25))), 3))


def _twice(node: Node, s: SparkSession, ask: Coordinates) -> Coverage:
    """The second evaluation, which finds what the first one stored."""
    node.eval(ask, s)
    return node.eval(ask, s)


def _grown(node: Node, s: SparkSession) -> Coverage:
    """A part first, then all."""
    node.eval(Coordinates.grid(lat=(0, 9, 10), lon=(0, 26, 27)), s)
    return node.eval(_WHOLE, s)


def _scratch(s: SparkSession) -> str:
    """A fresh folder under the shared one that the session names, or under its warehouse."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/lodegrid-{uuid.uuid4().hex}"
