import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.functions import crs, expressions, timeunits, units
from lodegrid.functions.style import Style
from lodegrid.operators import algebra, convolve, interpolate
from lodegrid.operators.caches import Store, expiry
from lodegrid.plans.coordinates import Axis, UniformAxis
from lodegrid.plans.coverage import Coverage
from lodegrid.sources import tables
from lodegrid.streaming.resample import resample_stream


def value(spark, text, **inputs):
    df = spark.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in inputs.items()), F.lit(1.0).alias("__"))
    return df.select(expressions.column(text, {k: F.col(k) for k in inputs}).alias("v")).head()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("a + b * 2", 9), ("a / 0", math.inf), ("-a / 0", -math.inf), ("0 / 0 + a", None), ("a // 2", 1), ("-a // 2", -2), ("-a % 2", 1), ("a ** 2", 9), ("where(a > b, 1, 2)", 2), ("(a == 3) & (b != 3)", 0), ("~(a == 3)", 0), ("1 < a <= 3", 1), ("sqrt(a - 4)", None), ("log(0 * a)", -math.inf), ("floor(-a / 2)", -2)],
)
def test_expressions(spark, text, want):
    got = value(spark, text, a=3, b=3)
    assert got == want or (got is not None and want is not None and math.isclose(got, want))


def test_expressions_are_closed():
    for bad in ("__import__('os')", "a.b", "[1]", "lambda: 1", "open('x')", "a if b else a", "f'{a}'"):
        with pytest.raises(expressions.ExpressionError):
            expressions.column(bad, {})


def test_units(spark):
    assert units.factor("km", "m") == 1000 and math.isclose(units.factor("m / s", "km / hour"), 3.6)
    assert units.result("*", "m", "s")[0] == "m * s" and units.result("+", "m", "ft") == ("m", 0.3048)
    assert units.power("m", 2) == "m ** 2"
    for op in "+<":
        with pytest.raises(units.UnitError):
            units.result(op, "m", None)
    with pytest.raises(units.UnitError):
        units.factor("m", "s")
    c = Coverage(spark.createDataFrame([(1.0, 2.0)], "lat double, value double"), ("lat",), attrs={"units": "km"})
    assert algebra.convert(c, "m").df.head().value == 2000
    assert algebra.binary("*", c, c).units and algebra.binary("<", c, 3).df.head().value == 1


def test_steps():
    assert timeunits.step("-15,D") == np.timedelta64(-15, "D") and timeunits.step_text(np.timedelta64(1, "M")) == "1,M"
    assert timeunits.divide(np.timedelta64(1, "D"), np.timedelta64(6, "h")) == 4 and timeunits.divisible(np.timedelta64(1, "D"), np.timedelta64(6, "h"))
    with pytest.raises(ValueError):
        timeunits.step("1,fortnight")


def test_crs():
    y, x = crs.transform_value(45, 90, crs.DEFAULT, "EPSG:3857")
    assert math.isclose(x, 10018754.171394622) and math.isclose(y, 5621521.486192066)
    assert math.isclose(crs.geodesic(0, 0, 0, 1), 111319.49079327358, rel_tol=1e-9)
    assert math.isclose(crs.distance((0, 0), (3, 4), "EPSG:3857"), 5)
    with pytest.raises(crs.UnsupportedCRS):
        crs.kind("EPSG:32633")


def test_irregular_axes_and_ties(spark):
    c = Coverage(spark.createDataFrame([(float(v), v * 10.0) for v in (0, 1, 4, 9)], "lat double, value double"), ("lat",))
    ask = Axis([-1, 0.5, 2.5, 2.6, 9, 9.1], "lat").frame(spark)
    got = {r.lat: r.value for r in interpolate.nearest_irregular(c, ask, "lat", Axis([0, 1, 4, 9], "lat")).df.collect()}
    assert got == {-1: None, 0.5: 0, 2.5: 10, 2.6: 40, 9: 90, 9.1: None}
    many = Axis([float(i * i) for i in range(200)], "lat")
    big = Coverage(many.frame(spark).select("lat", F.col("lat").alias("value")), ("lat",))
    got = interpolate.nearest_irregular(big, Axis([2.6, 1000.0, 39600.0], "lat").frame(spark), "lat", many).df.collect()
    assert sorted(r.value for r in got) == [4, 1024, 39601]


def test_gaps(spark):
    c = Coverage(spark.createDataFrame([(0.0, None), (1.0, 2.0), (2.0, None), (4.0, 8.0)], "lat double, value double"), ("lat",))
    assert [r.value for r in interpolate.fill_missing(c, "lat").df.orderBy("lat").collect()] == [None, 2, 4, 8]


def test_no_frame_goes_over_the_rest_of_a_group(spark):
    rows = [(float(v), float(k), None if v % 4 else v * 10.0) for v in range(40) for k in (1, 2)]
    c = Coverage(spark.createDataFrame(rows, "lat double, lon double, value double"), ("lat", "lon"))
    line, ask = c.with_df(c.df.where("lon = 1").drop("lon"), dims=["lat"]), Axis([-1, 2.5, 8, 50], "lat")
    made = [interpolate.fill_missing(c, "lat"), interpolate.fill_missing(line, "lat"), interpolate.fill_carried(c, "lat", 1.0), interpolate.as_of(line, ask.frame(spark), "lat", "next"), interpolate.nearest_sorted(line, ask.frame(spark), "lat", ask)]
    for m in made:
        assert "unboundedfollowing" not in m.df._jdf.queryExecution().toString().lower()
    assert {r.lat: r.value for r in made[3].df.collect()} == {-1: 0, 2.5: 40, 8: 80, 50: None}
    got = {(r.lat, r.lon): r.value for r in made[2].df.collect()}
    assert got == {(v, k): (None if v % 4 == 2 else v // 4 * 40.0 if v % 4 < 2 else (v + 1) * 10.0 if v < 39 else None) for v, k, _ in rows}


@pytest.mark.parametrize("reach", [0, 1, 2, 6, 40])
def test_carried_cells_are_the_filled_ones(spark, reach):
    rng = random.Random(reach)
    start = datetime(2024, 1, 1)
    cells = [(k, start + timedelta(hours=h), rng.choice([None, float(h)])) for k in range(12) for h in range(72) if rng.random() < (k + 1) / 12 * 0.5]
    c = Coverage(spark.createDataFrame(cells, "station long, time timestamp, value double"), ("station", "time"))
    ends = spark.createDataFrame([(start, start + timedelta(hours=71, minutes=59))], "lo timestamp, hi timestamp")
    every = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("time"))
    dense = c.with_df(spark.range(12).toDF("station").crossJoin(every).join(c.df, ["station", "time"], "left"))
    want = {(r.station, r.time): r.value for r in interpolate.fill_carried(dense, "time", reach * 3600).df.collect() if r.value is not None}
    got = interpolate.carried_cells(c, "time", "1,h", reach * 3600, ends).df.collect()
    assert want and len(got) == len(want) and {(r.station, r.time): r.value for r in got} == want


def test_convolution_forms_agree(spark):
    axis = UniformAxis(0, 9, size=10, name="lat")
    c = Coverage(axis.frame(spark).select("lat", (F.col("lat") ** 2).alias("value")), ("lat",))
    for w in ([1, 2, 4], [1, 2, 3, 4], [5]):
        want = np.convolve(np.arange(10.0) ** 2, w, mode="same")
        a = [r.value for r in convolve.convolve(c, w, {"lat": axis}).df.orderBy("lat").collect()]
        b = [r.value for r in convolve.convolve_1d(c, w, "lat").df.orderBy("lat").collect()]
        assert np.allclose(a, want) and np.allclose(b, want), w
    assert np.isclose(convolve.kernel("gaussian,3,1", 2).sum(), 1)


def test_ingest(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, -9999.0), (None, 3.0), (4.0, 5.0)], "lat double, v double")
    c = Coverage.of(df, ["lat"], nan_vals=[-9999])
    assert sorted(((r.lat, r.v) for r in c.df.collect())) == [(1, None), (2, None), (4, 5)]
    t = tables.decode_cf_time(spark.createDataFrame([(1.5,)], "time double"), "time", "days since 2000-01-01").head()[0]
    assert str(t) == "2000-01-02 12:00:00"
    assert tables.with_boundary(c, {"lat": 0.5}).df.where("lat = 4").head().lat_hi == 4.5
    with pytest.raises(NotImplementedError):
        tables.with_boundary(c, {"lat": [1, 2]})


def test_style_and_store(tmp_path, spark):
    s = Style(name="x", enumeration_legend={1: "wet"}, enumeration_colors={1: "#00f"})
    assert Style.from_json(s.json) == s
    assert [r[0] for r in spark.range(1, 3).select(s.label(F.col("id"))).collect()] == ["wet", "unknown"]
    store = Store(str(tmp_path))
    store.put("a", "k", 1)
    store.put("a", "old", 2, expires=-1)
    assert store.get("a", "k") == 1 and not store.has("a", "old") and store.cleanup() == 1 and store.remove("*") == 1
    assert expiry("1,h", now=0) == 3600 and expiry("1970-01-02") == 86400


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", 1, float(h)) for h in range(5) for m in (0, 30)]
    spark.createDataFrame(rows, "t string, k int, v double").select(F.to_timestamp("t").alias("t"), "k", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k int, v double").parquet(str(tmp_path / "in"))
    q = resample_stream(stream, "t", "1,h", "mean", ["k"], "v").writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.value for r in spark.sql("select * from hourly").collect()) == [0, 1, 2, 3, 4]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    from lodegrid.operators import reduce

    values = [*rng.normal(0, 1e6, 300), *rng.integers(-3, 3, 200).astype(float), 0.0, -0.0, 2.0**40, np.nextafter(2.0**40, 0), 1e-300, float("inf"), -float("inf"), None, None]
    rows = [(float(i % 3), None if v is None else float(v)) for i, v in enumerate(values)] + [(9.0, None), (8.0, 7.0)]
    df = spark.createDataFrame(rows, "k double, v double").repartition(3)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.v for r in reduce.exact_quantile(df, ["k"], ["v"], share).collect()}
        want = {r.k: r.v for r in df.groupBy("k").agg(F.percentile("v", share).alias("v")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got if want[k] is not None)
        assert {k for k in got if got[k] is None} == {9.0}
    whole = reduce.exact_quantile(df, [], ["v"], 0.5).collect()
    assert [r.v for r in whole] == [r.v for r in df.agg(F.percentile("v", 0.5).alias("v")).collect()]
    assert [r.v for r in reduce.exact_quantile(df.limit(0), [], ["v"], 0.5).collect()] == [None]
    ordered = df.where("v is not null").select("v", reduce.histogram_cell(F.col("v")).alias("c")).orderBy("v").collect()
    assert all(a.c <= b.c for a, b in zip(ordered, ordered[1:], strict=False))
