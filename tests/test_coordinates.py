import json

import numpy as np
import pytest

from lodegrid.functions import timeunits as tu
from lodegrid.plans.coordinates import AffineGrid, Axis, Coordinates, GroupCoordinates, PolarGrid, Stack, UniformAxis, add_valid_dimension, clinspace, concat, crange, merge_dims, union


@pytest.mark.parametrize(
    ("bounds", "inner", "outer"),
    [
        ((35, 55), [40, 50], [30, 40, 50, 60]),
        ((30, 60), [30, 40, 50, 60], [30, 40, 50, 60]),
        ((45, 100), [50, 60, 70], [40, 50, 60, 70]),
        ((5, 55), [20, 30, 40, 50], [20, 30, 40, 50, 60]),
        ((52, 55), [50, 60], [50, 60]),
        ((70, 30), [], []),
        ((80, 90), [], []),
    ],
)
def test_uniform_selection(bounds, inner, outer):
    for axis, order in ((UniformAxis(20, 70, 10, name="lat"), 1), (UniformAxis(70, 20, -10, name="lat"), -1)):
        assert axis.select(bounds).coordinates.tolist() == inner[::order]
        assert axis.select(bounds, outer=True).coordinates.tolist() == outer[::order]


def test_listed_selection():
    messy = Axis([20, 50, 60, 90, 40, 10], "lat")
    assert messy.select((30, 55)).coordinates.tolist() == [50, 40]
    assert messy.select((52, 55)).size == 0
    line = Axis(range(10), "lat")
    for b, want in (((5.6, 6.1), [6]), ((5.6, 5.6), [6]), ((5.4, 5.4), [5]), ((5.4, 5.6), [5, 6]), ((9.1, 9.1), []), ((-0.1, -0.1), [])):
        assert line.select(b).coordinates.tolist() == want
        assert UniformAxis(0, 9, 1, name="lat").select(b).coordinates.tolist() == want


def test_selection_respects_time_precision():
    c = UniformAxis("2012-05-19", "2012-05-20", "1,D", name="time")
    c2 = UniformAxis("2012-05-20T12:00:00", "2012-05-21T12:00:00", "1,D", name="time")
    assert (c.select(c2.bounds, outer=True).size, c.select(c2.bounds).size, c2.select(c.bounds).size) == (1, 0, 1)
    with pytest.raises(TypeError):
        c.select((1, 2))


def test_months_clamp():
    axis = UniformAxis("2018-01-31", "2018-05-31", "1,M", name="time")
    assert axis.coordinates.astype(str).tolist() == ["2018-01-31", "2018-02-28", "2018-03-31", "2018-04-30", "2018-05-31"]
    assert str(tu.add(np.datetime64("2020-02-29"), np.timedelta64(1, "Y"))) == "2021-02-28"


def test_identity_and_json():
    c = Coordinates.grid(lat=(0, 10, 5), lon=[1, 2, 3], time=("2018-01-01", "2018-01-03", "1,D"))
    assert c.shape == (5, 3, 3) and c.size == 45 and c.dims == ["lat", "lon", "time"]
    again = Coordinates.from_json(c.json)
    assert again == c and again.hash == c.hash == c.transpose("time", "lon", "lat").hash
    assert (2.5, 2, "2018-01-02") in c and (2.6, 2, "2018-01-02") not in c
    assert json.loads(c.json)["crs"] == c.crs
    assert [x.shape for x in c.iterchunks((2, 3, 3))] == [(2, 3, 3), (2, 3, 3), (1, 3, 3)]
    assert Coordinates([]).size == 0


def test_algebra():
    a, b = Coordinates.grid(lat=[1, 2, 3], lon=[4, 5]), Coordinates.grid(lat=[3, 4], lon=[5, 6])
    assert concat([a, b]).axis("lat").coordinates.tolist() == [1, 2, 3, 3, 4]
    assert union([a, b]).axis("lat").coordinates.tolist() == [1, 2, 3, 4]
    assert a.intersect(b).axis("lat").coordinates.tolist() == [3]
    assert Coordinates.grid(lat=[1, 3], lon=[4]).issubset(a) and not b.issubset(a)
    assert a.drop("lat").dims == ["lon"] and a.transpose("lon", "lat").dims == ["lon", "lat"]
    s = Coordinates.points(lat=[1, 2], lon=[4, 5])
    assert s.dims == ["lat_lon"] and s.unstack().shape == (2, 2) and s.issubset(a) and s.udrop("lat").dims == ["lon"]
    assert merge_dims([Coordinates.grid(lat=[1]), Coordinates.grid(lon=[2, 3])]).shape == (1, 2)
    with pytest.raises(ValueError):
        merge_dims([a, b])
    with pytest.raises(KeyError):
        a.drop("time")
    g = GroupCoordinates([a]) + GroupCoordinates([b])
    assert len(g) == 2
    with pytest.raises(ValueError):
        g.append(Coordinates.grid(lat=[1]))


def test_constructors():
    assert isinstance(crange([0, 1], [3, 4], [1, 1], "lat_lon"), Stack)
    assert clinspace(0, 1, 3, "lat").coordinates.tolist() == [0, 0.5, 1]
    assert UniformAxis(0, 1, 0.1, name="lat").size == 11
    with pytest.raises(ValueError):
        UniformAxis(0, 1, name="lat")
    with pytest.raises(ValueError):
        Coordinates.grid(lat=[1], alt=[2], crs="EPSG:4326")
    with pytest.raises(ValueError):
        add_valid_dimension("a_b")
    u = Coordinates.from_url("http://x/?SERVICE=WMS&VERSION=1.3.0&CRS=EPSG:4326&BBOX=0,0,10,20&WIDTH=4&HEIGHT=2")
    assert u.axis("lat").coordinates.tolist() == [7.5, 2.5] and u.axis("lon").coordinates.tolist() == [2.5, 7.5, 12.5, 17.5]
    assert Axis([0, 0.5, 1.0], "lat").simplify().uniform and not Axis([0, 0.4, 1.0], "lat").simplify().uniform


def test_affine_and_polar(spark):
    a = AffineGrid((10, 0.5, 0, 50, 0, -1), (4, 6))
    lat, lon = a.simplify()
    assert lat.coordinates.tolist() == [49.5, 48.5, 47.5, 46.5] and lon.size == 6
    assert a.select({"lat": (47, 48)}, outer=True).shape == (3, 6) and a.select({"lat": (47, 48)}).size == 6
    assert a.frame(spark).count() == 24
    p = PolarGrid((5, 6), [1, 2], theta_size=4)
    assert p.size == 8 and p.frame(spark).count() == 8
    with pytest.raises(ValueError):
        PolarGrid((0, 0), [0], theta_size=4)


def test_transform_round_trip():
    c = Coordinates.grid(lat=(0, 10, 3), lon=(0, 10, 3))
    back = c.transform("EPSG:3857").transform(c.crs)
    assert np.allclose(back.axis("lat").coordinates, [0, 5, 10]) and np.allclose(back.axis("lon").coordinates, [0, 5, 10])
    r = c.horizontal_resolution("km")
    assert 552 < r["lat"] < 554 and 553 < r["lon"] < 556


def test_frames(spark):
    c = Coordinates.grid(lat=(0, 10, 3), time=("2018-01-01", "2018-01-02", "12,h"))
    rows = c.frame(spark).orderBy("__i_lat", "__i_time").collect()
    assert len(rows) == 9 and rows[4].lat == 5 and str(rows[4].time) == "2018-01-01 12:00:00"
    p = Coordinates.points(lat=[1, 2], lon=[3, 4], time=["2018-01-01", "2018-02-01"]).frame(spark).collect()
    assert [(r.lat, r.lon, r.time.month) for r in p] == [(1, 3, 1), (2, 4, 2)]
