"""Golden values of the reference's own tests, on the node interface."""

import gzip
import json
import zlib

import numpy as np
import pytest

import lodegrid
from lodegrid import Coordinates, Node, crange
from lodegrid.algorithm import Arange, Arithmetic, BetaFitDayOfYear, Combine, Convolution, CoordData, Count, DayOfYearWindow, ExpandCoordinates, GroupReduce, Kurtosis, Mask, Max, Mean, Median, Min, Percentile, Reproject, ResampleReduce, SelectCoordinates, SinCoords, Skew, StandardDeviation, Sum, TransformTimeUnits, Variance, YearSubstituteCoordinates
from lodegrid.caches import HashCache, PartialCache
from lodegrid.compositor import OrderedCompositor, TileCompositor
from lodegrid.data import CSV, Array, Dataset, Overviews, Table, Zarr, ZarrMemory
from lodegrid.interpolators import Interpolate
from lodegrid.managers import Parallel
from lodegrid.operators import interpolate
from lodegrid.plans.coordinates import concat
from lodegrid.plans.node import NodeException, describe_operators
from lodegrid.sources import sinks, zarr
from lodegrid.sources.nodes import MissingLibrary

NAN = np.nan


def dense(c):
    return sinks.to_array(c)


def cube():
    coords = Coordinates([[0, 1, 2, 3], [0, 1, 2, 3], ["2020-01-01", "2020-01-05", "2020-01-09", "2020-01-13"]], dims=["lat", "lon", "time"])
    return Array(source=np.arange(64.0).reshape(4, 4, 4), coordinates=coords)


def test_mixed_interpolation(spark):
    node = cube()
    one = lambda lat, lon, t: Coordinates([lat, lon, [t]], dims=["lat", "lon", "time"])
    mixed = Interpolate(source=node, interpolation=[{"method": "bilinear", "dims": ["lat", "lon"]}, {"method": "nearest", "dims": ["time"]}])
    assert np.allclose(dense(Interpolate(source=node, interpolation="nearest").eval(one([1.2], [1.3], "2020-01-05"), spark)), 21)
    assert np.allclose(dense(mixed.eval(one([1.2], [1.3], "2020-01-05"), spark)), 25.4)
    got = dense(mixed.eval(one([1, 1.2], [1, 1.3], "2020-01-05"), spark))[..., 0]
    assert np.allclose(got, [[21, 22.2], [24.2, 25.4]])
    linear = Interpolate(source=node, interpolation=[{"method": "nearest", "dims": ["lat", "lon"]}, {"method": "linear", "dims": ["time"]}])
    assert np.allclose(dense(linear.eval(one([1], [1], "2020-01-06"), spark)), 21.25)


def test_nearest_on_a_line(spark):
    axis = Coordinates.grid(lat=(0, 10, 5))
    node = Array(source=np.arange(5.0), coordinates=axis)
    ask = Coordinates([[1, 1.2, 1.5, 5, 9]], dims=["lat"])
    assert dense(node.interpolate("nearest").eval(ask, spark)).tolist() == [0, 0, 1, 2, 4]
    tight = node.interpolate({"method": "nearest", "params": {"spatial_tolerance": 1.1}})
    assert np.array_equal(dense(tight.eval(ask, spark)), [0, NAN, 1, 2, 4], equal_nan=True)


def test_linear_outside_is_missing(spark):
    node = Array(source=np.arange(25.0).reshape(5, 5), coordinates=Coordinates.grid(lat=(0, 10, 5), lon=(0, 10, 5)))
    ask = Coordinates.grid(lat=(1, 11, 5), lon=(1, 11, 5))
    got = dense(node.interpolate("linear").eval(ask, spark))
    assert np.isnan(got[4]).all() and np.isnan(got[:, 4]).all() and np.isclose(got[0, 0], 2.4)


def test_points(spark):
    own = Coordinates([[[0, 2, 1], [10, 12, 11], ["2018-01-01", "2018-01-02", "2018-01-03"]]], dims=["lat_lon_time"])
    node = Array(source=[0, 1, 2], coordinates=own).interpolate("nearest")
    assert dense(node.eval(Coordinates([[0.5, 1.5], [10.5, 11.5]], dims=["lat", "lon"]), spark)).tolist() == [[0, 2], [2, 1]]
    pairs = node.eval(Coordinates([[[0.5, 1.5], [10.5, 11.5]]], dims=["lat_lon"]), spark).df.collect()
    assert {(r.lat, r.lon): r.value for r in pairs} == {(0.5, 10.5): 0, (1.5, 11.5): 1}
    assert dense(node.eval(Coordinates([["2018-01-01"]], dims=["time"]), spark)).tolist() == [0]
    grid = Array(source=np.arange(25.0).reshape(5, 5), coordinates=Coordinates.grid(lat=(0, 4, 5), lon=(0, 4, 5)))
    ask = Coordinates.points(lat=[0.2, 3.5], lon=[3.9, 1.5])
    got = {r.lat: r.value for r in grid.interpolate("nearest").eval(ask, spark).df.collect()}
    assert got == {0.2: 4, 3.5: 16}
    got = {r.lat: r.value for r in grid.interpolate("bilinear").eval(ask, spark).df.collect()}
    assert np.isclose(got[0.2], 4.9) and np.isclose(got[3.5], 19)


def test_ordered_fill_with_gaps(spark):
    a = np.ones((3, 3))
    a[0] = NAN
    b = np.zeros((4, 4))
    b[:, 0] = NAN
    a = Array(source=a, coordinates=Coordinates.grid(lat=[-1, 0, 1], lon=[10, 20, 30])).interpolate("bilinear")
    b = Array(source=b, coordinates=Coordinates.grid(lat=[0, 1, 2, 3], lon=[10, 20, 30, 40])).interpolate("bilinear")
    ask = Coordinates.grid(lat=[0, 1, 2], lon=[10, 20, 30, 40, 50])
    got = dense(OrderedCompositor(sources=[a, b]).eval(ask, spark))
    assert np.array_equal(got[:2], [[1, 1, 1, 0, NAN], [1, 1, 1, 0, NAN]], equal_nan=True) and np.array_equal(got[2][[0, 2, 3, 4]], [NAN, 0, 0, NAN], equal_nan=True)


def test_tiles(spark):
    tiles = [Array(source=np.arange(5.0) + 100 * k, coordinates=Coordinates.grid(lat=(5 * (k - 1), 5 * (k - 1) + 4, 5))) for k in (1, 2, 3)]
    ask = Coordinates([[3.5, 4.5, 5.5]], dims=["lat"])
    raw = TileCompositor(sources=tiles).eval(ask, spark)
    assert {r.lat: r.value for r in raw.df.collect()} == {3: 103, 4: 104, 5: 200, 6: 201}
    smooth = TileCompositor(sources=tiles).interpolate("bilinear").eval(ask, spark)
    assert dense(smooth).tolist() == [103.5, 152.0, 200.5]


def test_source_pruning(spark):
    parts = [Array(source=np.full((1, 2), v), coordinates=Coordinates([[t], [0, 1]], dims=["time", "lat"])) for t, v in ((0.0, 1.0), (10.0, 2.0))]
    node = TileCompositor(sources=parts, source_coordinates=Coordinates([[0, 10]], dims=["time"]))
    ask = lambda t: Coordinates([[t], [0, 1]], dims=["time", "lat"])
    assert dense(node.eval(ask(0), spark)).tolist() == [[1, 1]] and dense(node.eval(ask(10), spark)).tolist() == [[2, 2]]
    assert np.isnan(dense(node.eval(ask(100), spark))).all()


def test_reductions(spark):
    rng = np.random.default_rng(1)
    x = rng.random((5, 4, 6))
    x[3, 0, 0] = x[0, 3, 0] = x[0, 0, 3] = NAN
    coords = Coordinates.grid(lat=(0, 1, 5), lon=(0, 1, 4), time=("2018-01-01", "2018-01-06", "1,D"))
    node = Array(source=x, coordinates=coords)
    z = lambda a, p: np.nanmean((a - np.nanmean(a)) ** p) / np.nanvar(a) ** (p / 2)
    want = {Min: np.nanmin, Max: np.nanmax, Sum: np.nansum, Mean: np.nanmean, Variance: np.nanvar, StandardDeviation: np.nanstd, Median: np.nanmedian, Count: lambda a: (~np.isnan(a)).sum(), Skew: lambda a: z(a, 3), Kurtosis: lambda a: z(a, 4) - 3}
    for kind, f in want.items():
        assert np.isclose(kind(source=node).eval(coords, spark).df.head()[0], f(x)), kind
    by_cell = dense(Mean(source=node, dims=["time"]).eval(coords, spark))
    assert np.allclose(by_cell, np.nanmean(x, axis=2))
    assert np.isclose(Percentile(source=node, percentile=30).eval(coords, spark).df.head()[0], np.nanpercentile(x, 30))


def test_empty_groups(spark):
    node = Array(source=np.full((2, 2), NAN), coordinates=Coordinates.grid(lat=[0, 1], lon=[0, 1]))
    ask = Coordinates.grid(lat=[0, 1], lon=[0, 1])
    assert Sum(source=node).eval(ask, spark).df.head()[0] == 0 and Mean(source=node).eval(ask, spark).df.head()[0] is None and Count(source=node).eval(ask, spark).df.head()[0] == 0


def test_day_of_year_window(spark):
    ask = concat([Coordinates([crange("1999-12-29", "2000-01-02", "1,D", "time")]), Coordinates([crange("2001-12-30", "2002-01-03", "1,D", "time")])])
    assert dense(DayOfYearWindow(source=Arange(), window=1, reduce_fn="count").eval(ask, spark)).tolist() == [2, 2, 1, 1, 2, 2]
    ask = concat([Coordinates([crange("1999-12-29", "2000-01-03", "1,D", "time")]), Coordinates([crange("2001-12-30", "2002-01-02", "1,D", "time")])])
    got = DayOfYearWindow(source=Arange(), window=2, reduce_fn="count").eval(ask, spark)
    assert {r.time: r.value for r in got.df.collect()} == {1: 6, 2: 5, 3: 3, 363: 3, 364: 5, 365: 6}
    by_node = DayOfYearWindow(source=Arange(), window=2, scale_min=SinCoords(), scale_float=[None, 9.0], rescale=True)
    assert set(by_node.inputs) == {"source", "scale_min"}


def test_convolution(spark):
    assert np.allclose(Convolution(source=Arange(), kernel_type="mean,5", kernel_dims=["lat", "lon"]).weights(), 0.04)
    assert np.allclose(Convolution(source=Arange(), kernel_type="mean,5", kernel_dims=["lat", "lon", "time"]).weights(), 0.008)
    ask = Coordinates.grid(lat=(0, 9, 10))
    got = dense(Convolution(source=CoordData(coord_name="lat"), kernel=[1, 2, 4], kernel_dims=["lat"]).eval(ask, spark))
    wide = np.convolve(np.arange(-2.0, 12), [1, 2, 4], mode="same")[2:12]
    assert np.allclose(got, wide)
    with pytest.raises(TypeError):
        Convolution(source=Arange(), kernel=[1, 2, 1], kernel_type="mean,5", kernel_dims=["lat"])
    with pytest.raises(TypeError):
        Convolution(source=Arange(), kernel_dims=["lat"])


@pytest.mark.parametrize(("op", "f"), [("==", np.equal), ("<", np.less), ("<=", np.less_equal), (">", np.greater), (">=", np.greater_equal)])
def test_mask(spark, op, f):
    ask = Coordinates.grid(lat=(0, 1, 4), lon=(0, 1, 3))
    got = dense(Mask(source=Arange(), mask=Arange(), bool_val=5, bool_op=op, masked_val=-1).eval(ask, spark))
    x = np.arange(12.0).reshape(4, 3)
    assert np.array_equal(got, np.where(f(x, 5), -1, x))


def test_arithmetic(spark):
    ask = Coordinates.grid(lat=[1, 2], lon=[3, 4])
    node = Arithmetic(eqn="{k} * A + abs(B) / 2", params={"k": 2}, A=CoordData(coord_name="lat"), B=CoordData(coord_name="lon"))
    assert dense(node.eval(ask, spark)).tolist() == [[3.5, 4], [5.5, 6]]
    zero = Arithmetic(eqn="1 / (A - 1)", A=CoordData(coord_name="lat"))
    assert dense(zero.eval(ask, spark))[:, 0].tolist() == [np.inf, 1]
    with pytest.raises(ValueError):
        Arithmetic(eqn="__import__('os')", A=Arange()).eval(ask, spark)
    both = Combine(a=Arange(), b=SinCoords()).eval(ask, spark)
    assert both.outputs == ("a", "b") and both.df.count() == 4


def test_rewrites(spark):
    times = Coordinates([crange("2018-01-01", "2018-01-20", "1,D", "time")])
    node = Array(source=np.arange(20.0), coordinates=times)
    ask = Coordinates([["2018-01-05"]], dims=["time"])
    assert ExpandCoordinates(source=node, time=("-2,D", "1,D")).eval(ask, spark).df.count() == 4
    assert SelectCoordinates(source=node, time=("2018-01-03", "2018-01-06")).eval(ask, spark).df.count() == 4
    moved = YearSubstituteCoordinates(source=Arange(), year=2000).eval(Coordinates([["2019-02-28", "2020-02-29"]], dims=["time"]), spark)
    assert sorted(str(r.time)[:10] for r in moved.df.collect()) == ["2000-02-28", "2000-02-29"]
    assert {r.time for r in TransformTimeUnits(source=Arange(), time_units="dayofyear").eval(times, spark).df.collect()} == set(range(1, 21))
    assert dense(GroupReduce(source=Arange(), groupby="month", reduce_fn="sum").eval(times, spark)).tolist() == [190]
    assert dense(ResampleReduce(source=Arange(), resample="5,D", reduce_fn="count").eval(times, spark)).sum() == 20


def test_reproject(spark):
    fine = Coordinates.grid(lat=(0, 8, 9), lon=(0, 8, 9))
    node = Array(source=np.arange(81.0).reshape(9, 9), coordinates=fine)
    coarse = Coordinates.grid(lat=(0, 8, 3), lon=(0, 8, 3))
    got = dense(Reproject(source=node, coordinates=coarse, interpolation="bilinear").eval(fine, spark))
    rows = np.array([[0, 4, 8], [36, 40, 44], [72, 76, 80.0]])
    x = np.arange(9)
    want = np.array([np.interp(x, [0, 4, 8], r) for r in rows])
    want = np.array([np.interp(x, [0, 4, 8], c) for c in want.T]).T
    assert np.allclose(got, want)


def test_area_resampling(spark):
    node = Array(source=np.arange(16.0).reshape(4, 4), coordinates=Coordinates.grid(lat=(0, 3, 4), lon=(0, 3, 4)))
    ask = Coordinates.grid(lat=(0.5, 2.5, 2), lon=(0.5, 2.5, 2))
    for method, want in (("max", [[5, 7], [13, 15]]), ("average", [[2.5, 4.5], [10.5, 12.5]]), ("min", [[0, 2], [8, 10]])):
        assert dense(node.interpolate(method).eval(ask, spark)).tolist() == want


def test_splines(spark):
    x = np.linspace(0, 6, 7)
    node = Array(source=x**3, coordinates=Coordinates.grid(lat=(0, 6, 7)))
    got = dense(node.interpolate("cubic").eval(Coordinates([[0.5, 2.25, 5.9]], dims=["lat"]), spark))
    assert np.allclose(got, np.array([0.5, 2.25, 5.9]) ** 3)


@pytest.mark.parametrize(("method", "degree"), [("spline_2", 2), ("spline_3", 3), ("spline_4", 4), ("cubic_spline", 3), ("splinef2d", 3)])
def test_splines_keep_polynomials(spark, method, degree):
    x, at = np.array([0, 1, 2.5, 3, 4.5, 6, 7, 9]), [0.0, 0.5, 2.25, 5.9, 8.7, 9.0, 9.5]
    node = Array(source=np.outer(x**degree, [1, 2.0]), coordinates=Coordinates([x, [0, 1]], dims=["lat", "lon"]))
    got = dense(node.interpolate([{"method": method, "dims": ["lat"]}, {"method": "nearest", "dims": ["lon"]}]).eval(Coordinates([at, [0, 1]], dims=["lat", "lon"]), spark))
    assert np.allclose(got[:6], np.outer(np.array(at[:6]) ** degree, [1, 2])) and np.isnan(got[6]).all()


def test_even_splines_solve_their_conditions():
    rng = np.random.default_rng(3)
    x, y = np.cumsum(rng.random(12) + 0.1), rng.random(12)
    for degree in (2, 4):
        knots = interpolate.spline_knots(x, degree)
        assert len(knots) == len(x) + degree + 1
        assert np.allclose(interpolate.basis(x, knots, degree).sum(axis=1), 1)
        assert np.allclose(interpolate.polynomial(x, y, x, degree, "spline"), y)


def test_lanczos(spark):
    node = Array(source=np.full((9, 2), 5.0), coordinates=Coordinates.grid(lat=(0, 8, 9), lon=[0, 1]))
    got = dense(node.interpolate([{"method": "lanczos", "dims": ["lat"]}, {"method": "nearest", "dims": ["lon"]}]).eval(Coordinates([[0.3, 4.5, 7.9, 8.5], [0, 1]], dims=["lat", "lon"]), spark))
    assert np.allclose(got[:3], 5) and np.isnan(got[3]).all()


def table_node(spark, rows, dims=("lat",)):
    return Table(table=spark.createDataFrame(rows, f"{', '.join(f'{d} double' for d in dims)}, value double"), dims=list(dims), data="value")


def test_tables_without_declared_coordinates(spark):
    node = table_node(spark, [(float(i), 10.0 * i) for i in range(13)])
    ask = Coordinates([[2.4, 5.6]], dims=["lat"])
    want = {"nearest": [20, 60], "linear": [24, 56], "previous": [20, 50], "next": [30, 60], "zero": [20, 50]}
    assert {m: dense(node.interpolate(m).eval(ask, spark)).tolist() for m in want} == want
    assert dense(node.interpolate("nearest").eval(Coordinates([[5.6]], dims=["lat"]), spark)).tolist() == [60]
    odd = table_node(spark, [(0.0, 0.0), (1.0, 10.0), (5.0, 50.0), (7.0, None), (20.0, 200.0)])
    ask = Coordinates([[-1, 0.5, 3, 4, 6.5, 7, 19, 30]], dims=["lat"])
    got = {m: dense(odd.interpolate(m).eval(ask, spark)) for m in ("nearest", "linear", "previous", "next")}
    assert np.array_equal(got["nearest"], [NAN, 0, 10, 50, NAN, NAN, 200, NAN], equal_nan=True)
    assert np.array_equal(got["linear"], [NAN, 5, 30, 40, NAN, NAN, NAN, NAN], equal_nan=True)
    assert np.array_equal(got["previous"], [NAN, 0, 10, 10, 50, 50, 50, 200], equal_nan=True)
    assert np.array_equal(got["next"], [0, 10, 50, 50, 200, 200, 200, NAN], equal_nan=True)
    empty = table_node(spark, [(0.0, 0.0)])
    none = Table(table=empty.attrs["table"].limit(0), dims=["lat"], data="value")
    assert np.isnan(dense(none.interpolate("nearest").eval(Coordinates([[1, 2]], dims=["lat"]), spark))).all()


def test_positions_among_requested_values(spark):
    from lodegrid.plans.coordinates import Axis, UniformAxis

    rng = np.random.default_rng(6)
    values = np.concatenate([rng.random(300) * 12 - 1, np.arange(0, 11, 0.1), [1e18, -1e18]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for axis in (UniformAxis(0, 10, 0.1, name="lat"), UniformAxis(10, 0, size=101, name="lat"), Axis(rng.random(200) * 10, "lat"), Axis([3, 1, 1, 2], "lat"), Axis([4.0], "lat")):
        points = np.unique([r.lat for r in axis.frame(spark).collect()])
        got = {r.v: r.p for r in df.select("v", interpolate.position(df.v, axis).alias("p")).collect()}
        assert all(got[v] == np.searchsorted(points, v) for v in values), axis


def test_points_of_a_table(spark, tmp_path):
    rng = np.random.default_rng(12)
    lat, lon = rng.random(30) * 4, rng.random(30) * 4
    p = tmp_path / "points.csv"
    p.write_text("lat,lon,data\n" + "".join(f"{a},{b},{i}\n" for i, (a, b) in enumerate(zip(lat, lon, strict=True))))
    table = Table(table=spark.createDataFrame([(float(a), float(b), float(i)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "lat double, lon double, value double"), dims=["lat", "lon"], data="value", stacked="lat_lon")
    for node in (CSV(source=str(p)), table):
        ask = Coordinates([[0.5, 3.3], [1.0, 2.5, 3.9]], dims=["lat", "lon"])
        got = dense(node.interpolate("nearest").eval(ask, spark))
        assert got.tolist() == [[float(np.hypot(lat - a, lon - b).argmin()) for b in (1.0, 2.5, 3.9)] for a in (0.5, 3.3)]
        pairs = node.interpolate("nearest").eval(Coordinates([[[0.5, 3.3], [1.0, 2.5]]], dims=["lat_lon"]), spark).df.collect()
        assert {(r.lat, r.lon): r.value for r in pairs} == {(a, b): float(np.hypot(lat - a, lon - b).argmin()) for a, b in ((0.5, 1.0), (3.3, 2.5))}


@pytest.mark.parametrize("tolerance", [None, 0.7])
def test_many_scattered_points(spark, monkeypatch, tolerance):
    monkeypatch.setattr(interpolate, "LISTED", 10)
    rng = np.random.default_rng(8)
    lat, lon = rng.random(60) * 10, rng.random(60) ** 3 * 50
    node = Array(source=np.arange(60.0), coordinates=Coordinates([[lat, lon]], dims=["lat_lon"]))
    ask = Coordinates([[-3, 1.5, 5, 9.9], [0.1, 3, 49, 80]], dims=["lat", "lon"])
    params = {"method": "nearest", "params": {"spatial_tolerance": tolerance} if tolerance else {}}
    got = dense(node.interpolate(params).eval(ask, spark))
    for i, a in enumerate([-3, 1.5, 5, 9.9]):
        for j, b in enumerate([0.1, 3, 49, 80]):
            d = np.hypot(lat - a, lon - b)
            assert got[i, j] == d.argmin() if tolerance is None or d.min() <= tolerance else np.isnan(got[i, j])


def test_plans_over_tables_keep_their_parallelism(spark):
    node = table_node(spark, [(float(i), 1.0 * i) for i in range(50)])
    plan = node.interpolate("previous").eval(Coordinates([[2.4, 5.6]], dims=["lat"]), spark).df._jdf.queryExecution().executedPlan().toString()
    source = plan[plan.index("SinglePartition") :] if "SinglePartition" in plan else ""
    assert "HashAggregate" in source or "SortAggregate" in source, "cells are reduced to the request's gaps before they meet in one task"


def test_definition_round_trip():
    a = Arange()
    node = Mean(source=Arithmetic(eqn="A + B", A=a, B=Mask(source=a, mask=a, bool_val=2)), dims=["time"])
    d = node.definition
    assert list(d)[0] == "Arange" and sum(k.startswith("Arange") for k in d) == 1
    again = Node.from_json(node.json)
    assert again == node and again.hash == node.hash
    with pytest.raises(NodeException):
        Node.from_definition({"a": {"node": "Mean", "inputs": {"source": "a"}}})
    with pytest.raises(ValueError):
        Node.from_definition({"a": {"node": "Arange", "wrong": 1}})
    with pytest.raises(AttributeError):
        node.dims = []
    assert "Mean" in describe_operators()
    assert Node.from_url("http://x/?SERVICE=WMS&LAYERS=Arange") == a


def test_csv(spark, tmp_path):
    p = tmp_path / "points.csv"
    p.write_text("lat,lon,time,altitude,data\n0,0,2018-01-01T12:00:00,0,0\n1,0,2018-01-01T12:00:00,0,1\n1,2,2018-01-01T12:00:03,4,4\n")
    node = CSV(source=str(p), alt_key="altitude")
    c = node.get_source_data(spark)
    assert c.dims == ("lat", "lon", "time", "alt") and c.outputs == ("value",) and c.df.count() == 3
    assert CSV(source=str(p), alt_key="altitude").get_source_data(spark, {"lat": [1, 2]}).df.count() == 2
    p.write_text("lat,lon\n0,1\n")
    with pytest.raises(ValueError, match="No data keys"):
        CSV(source=str(p)).get_source_data(spark)
    with pytest.raises(MissingLibrary):
        Dataset(source="x.nc", data_key="v").get_source_data(spark)


def zarr_store(version):
    """A store of two arrays over time and lat in chunks of 2 x 3, with a chunk that is not stored."""
    x = np.arange(20.0).reshape(4, 5)
    x[0, 0] = NAN
    files = {}

    def put(key, values, chunks, dims, attributes, skip=()):
        names = {"_ARRAY_DIMENSIONS": dims, **attributes}
        if version == 2:
            meta = {"zarr_format": 2, "shape": values.shape, "chunks": chunks, "dtype": values.dtype.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN" if values.dtype.kind == "f" else 0, "order": "F" if values.ndim > 1 else "C", "filters": None}
            files[f"{key}/.zarray"], files[f"{key}/.zattrs"] = json.dumps(meta).encode(), json.dumps(names).encode()
        else:
            meta = {"zarr_format": 3, "node_type": "array", "shape": values.shape, "data_type": str(values.dtype), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default"}, "fill_value": "NaN" if values.dtype.kind == "f" else 0, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 1}}], "attributes": attributes, "dimension_names": dims}
            files[f"{key}/zarr.json"] = json.dumps(meta).encode()
        for at in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunks, strict=True))):
            if at in skip:
                continue
            part = np.zeros(chunks, values.dtype)
            piece = values[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
            part[tuple(slice(n) for n in piece.shape)] = piece
            name = f"{key}/" + (".".join(map(str, at)) if version == 2 else "c/" + "/".join(map(str, at)))
            files[name] = zlib.compress(part.tobytes(order="F" if values.ndim > 1 else "C")) if version == 2 else gzip.compress(part.tobytes())

    put("rain", x, [2, 3], ["time", "lat"], {}, skip={(1, 1)})
    put("time", np.array([0, 1, 2, 5], "int32"), [3], ["time"], {"units": "days since 2020-01-01"})
    put("lat", np.linspace(10, 14, 5), [5], ["lat"], {})
    want = x.copy()
    want[2:, 3:] = NAN
    return files, want


@pytest.mark.parametrize("version", [2, 3])
def test_zarr(spark, tmp_path, version):
    files, want = zarr_store(version)
    for name, data in files.items():
        (tmp_path / "s" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / name).write_bytes(data)
    for node in (Zarr(source=str(tmp_path / "s")), ZarrMemory(source=files, data_key="rain")):
        own = node.get_coordinates()
        assert own.dims == ["time", "lat"] and str(own["time"].coordinates[3])[:10] == "2020-01-06"
        assert np.array_equal(dense(node.eval(own, spark)), want, equal_nan=True)
    at = Coordinates([["2020-01-02"], [10.2, 12.9]], dims=["time", "lat"])
    assert dense(node.interpolate("nearest").eval(at, spark)).tolist() == [[5, 8]]
    with pytest.raises(zarr.UnknownCodec):
        zarr.parse_layout({"zarr_format": 2, "shape": [1], "chunks": [1], "dtype": "<f8", "compressor": {"id": "blosc"}, "fill_value": 0})
    with pytest.raises(KeyError):
        Zarr(source=str(tmp_path / "s"), data_key="snow").get_coordinates()


def test_sources_check_dimensions(spark):
    node = cube()
    with pytest.raises(ValueError, match="lacks"):
        node.eval(Coordinates.grid(lat=[1]), spark)
    extra = Coordinates([[1], [1], ["2020-01-05"], [7]], dims=["lat", "lon", "time", "alt"])
    assert node.eval(extra, spark).dims == ("lat", "lon", "time")


def test_caches(spark, tmp_path):
    ask = Coordinates.grid(lat=(0, 5, 6))
    node = CoordData(coord_name="lat").cache(path=str(tmp_path / "c"))
    assert dense(node.eval(ask, spark)).tolist() == dense(node.eval(ask, spark)).tolist() == list(range(6))
    partial = PartialCache(source=CoordData(coord_name="lat"), path=str(tmp_path / "p"))
    partial.eval(ask, spark)
    from lodegrid.plans.node import Request

    more = Coordinates.grid(lat=(0, 7, 8))
    assert sorted(r.lat for r in partial.missing(Request(more, spark)).collect()) == [6, 7]
    assert dense(partial.eval(more, spark)).tolist() == list(range(8))
    with lodegrid.settings.override(ENABLE_CACHE=False):
        assert isinstance(node, HashCache) and dense(node.eval(ask, spark)).tolist() == list(range(6))


def test_resumable_chunks(spark, tmp_path):
    ask = Coordinates([[1, 2, 3, 4, 5]], dims=["time"])
    path = str(tmp_path / "out")
    Parallel(source=CoordData(coord_name="time"), chunks={"time": 2}, start_i=1).write(ask, path, spark)
    assert sorted(r.value for r in spark.read.parquet(path).collect()) == [3, 4, 5]
    Parallel(source=CoordData(coord_name="time"), chunks={"time": 2}).write(ask, path, spark)
    assert sorted(r.value for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]


def test_exports(spark, tmp_path):
    c = Arange().eval(Coordinates.grid(lat=[0, 1], lon=[0, 1, 2]), spark)
    sinks.write(c, str(tmp_path / "t"))
    assert dense(sinks.open_coverage(spark, str(tmp_path / "t"))).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert sinks.to_format(c, "png").startswith(b"\x89PNG") and sinks.to_dict(c)["data"]["value"] == [0, 1, 2, 3, 4, 5]
    sinks.to_format(c, "tiff", str(tmp_path / "x.tif"))
    assert (tmp_path / "x.tif").read_bytes()[:4] == b"II*\x00"


def test_overviews():
    levels = [Array(source=np.zeros(n), coordinates=Coordinates.grid(lat=(0, 8, n))) for n in (9, 5, 3)]
    node = Overviews(levels=levels, steps=(1, 2, 4))
    assert [node.pick(Coordinates.grid(lat=(0, 8, n))) for n in (17, 9, 5, 4, 2)] == [0, 0, 1, 1, 2]
    assert Overviews(levels=levels, steps=(1, 2, 4), closest=True).pick(Coordinates.grid(lat=(0, 7, 3))) == 2


def test_probe(spark):
    node = Arithmetic(eqn="A * 2", A=CoordData(coord_name="lat"))
    rows = node.probe(spark, lat=3, lon=4)
    assert [r["value"] for r in rows] == [3, 6] and rows[1]["inputs"] == [rows[0]["node_hash"]]
    assert all(r["active"] and r["label"] is None for r in rows) and rows[0]["name"] == "CoordData"
    grid = Coordinates.grid(lat=[0, 1], lon=[0, 1])
    a, b = (Array(source=np.full((2, 2), v), coordinates=grid, style={"name": n, "enumeration_legend": {"2": "two"}}) for v, n in ((NAN, "a"), (2.0, "b")))
    rows = {r["name"]: r for r in OrderedCompositor(sources=[a, b]).probe(spark, lat=1, lon=0)}
    assert (rows["a"]["active"], rows["b"]["active"], rows["b"]["label"]) == (False, True, "two")


def test_units_can_be_switched_off(spark):
    c = Arange().eval(Coordinates.grid(lat=[0, 1]), spark)
    from lodegrid.operators import algebra

    with lodegrid.settings.override(ENABLE_UNITS=False):
        out = algebra.binary("+", c.with_attrs(units="m"), c.with_attrs(units="kg"))
        assert out.units is None and sorted(r.value for r in out.df.collect()) == [0, 2]


def test_listed_axes_convolve_by_position(spark):
    at = [0.0, 1.0, 3.0, 4.0, 8.0]
    got = dense(Convolution(source=CoordData(coord_name="lat"), kernel=[1, 2, 4], kernel_dims=["lat"]).eval(Coordinates([at], dims=["lat"]), spark))
    wide = np.convolve([-1.0, *at, 12.0], [1, 2, 4], mode="same")[1:-1]
    assert np.allclose(got, wide)
    # a kernel that is no product of lines
    kernel = [[0, 1, 0], [1, 4, 1], [0, 1, 3]]
    ask = Coordinates.grid(lat=(0, 4, 5), lon=(0, 3, 4))
    got = dense(Convolution(source=CoordData(coord_name="lat"), kernel=kernel, kernel_dims=["lat", "lon"]).eval(ask, spark))
    x = np.repeat(np.arange(-1.0, 6)[:, None], 6, axis=1)
    want = sum(kernel[i][j] * x[2 - i : 7 - i, 2 - j : 6 - j] for i in range(3) for j in range(3))
    assert np.allclose(got, want)


def test_own_interpolator(spark):
    from lodegrid.interpolators import Interpolator
    from lodegrid.operators.nodes import PLUGGED

    class Floor(Interpolator):
        methods = ("test_floor",)

        def interpolate(self, c, dims, axes, asked, params, spark):
            return interpolate.carried(c, c.df, dims[0], asked.axis(dims[0]), Coordinates([asked.axis(dims[0])]).frame(spark))

    try:
        node = Array(source=[1.0, 2.0, 3.0], coordinates=Coordinates.grid(lat=[0, 1, 2])).interpolate("test_floor")
        assert dense(node.eval(Coordinates([[0.5, 1.0, 1.9]], dims=["lat"]), spark)).tolist() == [1, 2, 2]
    finally:
        PLUGGED.pop("test_floor")


def test_outputs_of_compositors(spark):
    grid = Coordinates.grid(lat=[0, 1])
    one = Array(source=[[1.0, 2.0], [3.0, 4.0]], coordinates=grid, outputs=["x", "y"])
    two = Array(source=[[5.0, 6.0], [7.0, 8.0]], coordinates=grid, outputs=["y", "z"])
    both = TileCompositor(sources=[one, two], auto_outputs=True).eval(grid, spark)
    assert both.outputs == ("x", "y", "z") and [tuple(r) for r in both.df.orderBy("lat").collect()] == [(0, 1, 2, 6), (1, 3, 4, 8)]
    some = TileCompositor(sources=[one, two], outputs=["z", "w"]).eval(grid, spark)
    assert some.outputs == ("z", "w") and {r.w for r in some.df.collect()} == {None}
    plain = Array(source=[1.0, 2.0], coordinates=grid)
    with pytest.raises(ValueError):
        TileCompositor(sources=[one, plain], auto_outputs=True).eval(grid, spark)
    assert TileCompositor(sources=[plain, plain]).get_source_data(spark, {"lat": [1, 2]}).df.count() == 1


def test_entries_expire(spark, tmp_path, monkeypatch):
    ask = Coordinates.grid(lat=(0, 1, 2))
    table = lambda v: Table(table=spark.createDataFrame([(0.0, v), (1.0, v)], "lat double, value double"), dims=["lat"], data="value")
    read = lambda v: dense(HashCache(source=table(v), path=str(tmp_path / "c"), uid="k", expires="1,h").eval(ask, spark)).tolist()
    from lodegrid.operators import caches

    assert read(1.0) == [1, 1] and read(2.0) == [1, 1]
    now = caches.time.time()
    monkeypatch.setattr(caches.time, "time", lambda: now + 7200)
    assert read(3.0) == [3, 3]


def test_beta_fit():
    from lodegrid.operators import climatology as cl

    x = np.random.default_rng(0).beta(2, 5, 4000)
    a, b = cl.fit(x)
    assert abs(a - 2) < 0.2 and abs(b - 5) < 0.4
    assert abs(cl.cumulative(2, 3, cl.quantile(2, 3, 0.3)) - 0.3) < 1e-9 and abs(cl.quantile(1, 1, 0.25) - 0.25) < 1e-9


def test_beta_fit_by_day(spark):
    from lodegrid.operators import climatology as cl

    rng = np.random.default_rng(1)
    days = np.array([f"{y}-{m:02d}-{d:02d}" for y in (2001, 2004) for m in (1, 2, 12) for d in range(1, 29)], "datetime64[D]")
    x = rng.beta(2, 3, len(days)) * 10
    x[5] = NAN
    ask = Coordinates([days], dims=["time"])
    got = {r.time: r for r in BetaFitDayOfYear(source=Array(source=x, coordinates=ask), percentiles=[0.5], window=5, scale_float=[0.0, 10.0]).eval(ask, spark).df.collect()}
    of_year = np.array([min(365, int(d.astype(int) - d.astype("datetime64[Y]").astype("datetime64[D]").astype(int)) + 1) for d in days])
    for t, r in got.items():
        gap = np.abs(of_year - min(t, 365))
        near = x[np.minimum(gap, 365 - gap) <= 2] / 10
        a, b = cl.fit(near)
        assert np.isclose(r.a, a, rtol=1e-6) and np.isclose(r.b, b, rtol=1e-6) and np.isclose(r.d0, cl.quantile(a, b, 0.5), rtol=1e-6)


def test_large_requests_filter_the_source(spark, monkeypatch):
    from lodegrid.operators import nodes

    monkeypatch.setattr(nodes, "BROADCAST_CELLS", 2)
    source = Array(source=np.arange(9.0), coordinates=Coordinates([crange(0, 8, 1)], dims=["lat"]))
    c = Interpolate(source=source, interpolation="nearest").eval(Coordinates([crange(0, 8, 2)], dims=["lat"]), spark)
    assert sorted((r.lat, r[c.outputs[0]]) for r in c.df.collect()) == [(x, x) for x in (0.0, 2.0, 4.0, 6.0, 8.0)]


def test_stores_and_properties(spark, tmp_path):
    from lodegrid.caches import CacheControl, MemoryStore, Store, cached_property

    control = CacheControl({"ram": MemoryStore(limit=200), "disk": Store(str(tmp_path / "s"), spark)})
    control.put("g", "k", [1, 2])
    control.put("g", "only", 3, mode="ram")
    assert control.get("g", "k", "disk") == [1, 2] and control.has("g", "only") and not control.has("g", "only", "disk")
    control.put("h", "gone", 1, expires=-5)
    assert not control.has("h", "gone") and control.cleanup() == 2 and control.remove("g", "k*") == 2
    for i in range(50):
        control.put("many", str(i), i, mode="ram")
    assert control.has("many", "49", "ram") and not control.has("many", "0", "ram")
    with pytest.raises(KeyError):
        control.get("g", "none")
    with pytest.raises(ValueError):
        control.clear("tape")
    calls = []

    class Counted(Arange):
        @cached_property(control=control)
        def answer(self):
            calls.append(1)
            return 42

    assert [Counted().answer, Counted().answer] == [42, 42] and len(calls) == 1


def test_labelled_keys_and_gap_filling(spark):
    c = Arange().eval(Coordinates.grid(lat=[0, 1, 2], lon=[5, 6]), spark)
    key = Table(table=spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (2.0, None)], "lat double, value double"), dims=["lat"], data="value").eval(Coordinates.grid(lat=[0, 1, 2]), spark)
    assert sorted(r.value for r in c[key].df.collect()) == [0, 1] and c["value"].outputs == ("value",)
    with pytest.raises(ValueError):
        key[c]
    node = Array(source=[0.0, NAN, NAN, 30.0], coordinates=Coordinates.grid(lat=[0, 1, 2, 3]))
    ask = Coordinates([[0.5, 2.5]], dims=["lat"])
    assert np.isnan(dense(node.interpolate("linear").eval(ask, spark))).all()
    assert dense(node.interpolate({"method": "linear", "params": {"fill_nan": True}}).eval(ask, spark)).tolist() == [5, 25]


def test_colours_of_enumerated_values(spark):
    c = Arange().eval(Coordinates.grid(lat=[0, 1], lon=[0, 1]), spark).with_attrs(style={"enumeration_colors": {"3": "#ff0000"}})
    png = sinks.to_png(c)
    raw = zlib.decompress(png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8])
    assert raw[1 + 4 : 1 + 8] == b"\xff\0\0\xff"
    cube_ = Arange().eval(Coordinates.grid(lat=[0, 1], lon=[0, 1], alt=[0, 1]), spark)
    with pytest.raises(ValueError):
        sinks.to_png(cube_)
