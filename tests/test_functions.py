"""Constants and round trips of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from skylattice.functions import camera as C
from skylattice.functions import geo
from skylattice.functions.grid import GridSpec, contains, snap


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_snap_is_ceiling_on_both_sides(spark):
    got = one(spark, *[snap(F.lit(v), 1.0) for v in (0.3, 1.0, -0.3, -2.0, 4.000001)])
    assert list(got) == pytest.approx([1.0, 1.0, 0.0, -2.0, 4.000001])


def test_grid_geometry():
    g = GridSpec(5, 10, 20, 25, 2)
    assert (g.cols, g.rows) == (11, 13) or (g.cols, g.rows) == (11, 14)


def test_every_index_is_met_once(spark):
    g = GridSpec(0.0, 0.0, 1000.0, 1000.0, 0.1)
    col, _ = g.index(F.col("id") * 0.1, F.lit(0.0))
    assert spark.range(10001).select(col.alias("c")).distinct().count() == 10001


def test_contains(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert list(one(spark, contains(lit(0, 0, 10, 10), lit(2, 2, 3, 3)), contains(lit(0, 0, 10, 10), lit(8, 2, 3, 3)))) == [True, False]


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(604347.0, 5792556.0)], "easting double, northing double")
    there = geo.with_steps(df, geo.utm_inverse("easting", "northing", "32")).select("latitude", "longitude")
    row = there.first()
    assert row.latitude == pytest.approx(52.273462, abs=1e-5) and row.longitude == pytest.approx(10.529350, abs=1e-5)
    back = geo.with_steps(there, geo.utm_forward("latitude", "longitude", "32")).first()
    assert back.easting == pytest.approx(604347, abs=1e-3) and back.northing == pytest.approx(5792556, abs=1e-3)


def test_southern_round_trip(spark):
    df = spark.createDataFrame([(-33.9, 18.4)], "latitude double, longitude double")
    utm = geo.with_steps(df, geo.utm_forward("latitude", "longitude", "34"))
    back = geo.with_steps(utm.select("easting", "northing"), geo.utm_inverse("easting", "northing", "34", "true")).first()
    assert back.latitude == pytest.approx(-33.9, abs=1e-7) and back.longitude == pytest.approx(18.4, abs=1e-7)


def test_zone_exceptions_and_bands(spark):
    df = spark.createDataFrame([(60.0, 5.0), (78.0, 15.0), (78.0, 5.0), (52.2, 10.5), (-81.0, 0.0), (83.0, 0.0)], "lat double, lon double")
    got = df.select(F.expr(geo.utm_zone("lat", "lon")).alias("z"), F.expr(geo.utm_band("lat")).alias("b")).collect()
    assert [r.z for r in got] == [32, 33, 31, 32, 31, 31] and [r.b for r in got] == ["V", "X", "X", "U", " ", "X"]


def test_tile_round_trip(spark):
    df = spark.createDataFrame([(52.27, 10.53)], "lat double, lon double").select("*", F.expr(geo.tile_x("lon", "11e0")).alias("tx"), F.expr(geo.tile_y("lat", "11e0")).alias("ty"))
    row = df.select("*", F.expr(geo.tile_lon("tx", "11")).alias("x0"), F.expr(geo.tile_lon("(tx + 1)", "11")).alias("x1"), F.expr(geo.tile_lat("ty", "11")).alias("y1"), F.expr(geo.tile_lat("(ty + 1)", "11")).alias("y0")).first()
    assert row.x0 <= 10.53 <= row.x1 and row.y0 <= 52.27 <= row.y1


def test_camera_ground_rectangle(spark):
    cam = C.Pinhole(1200, 1200, 600, 500, 1200, 1000)
    r = C.heading_rotation(F.lit(0.0))
    t = (F.lit(600.0), F.lit(500.0), F.lit(1200.0))
    hits = [C.plane_hit(r, t, cam, u, v, F.lit(0.0)) for u, v in cam.corners()]
    got = list(one(spark, *[c for h in hits for c in h]))
    assert (min(got[::2]), max(got[::2]), min(got[1::2]), max(got[1::2])) == pytest.approx((0, 1200, 0, 1000))


def test_projection_round_trip(spark):
    cam = C.Pinhole(1200, 1100, 600, 500, 1200, 1000)
    r, t = C.heading_rotation(F.lit(37.0)), (F.lit(10.0), F.lit(-4.0), F.lit(90.0))
    p = C.to_world(r, t, cam.ray(F.lit(123.0), F.lit(456.0), F.lit(50.0)))
    u, v = cam.to_image(*C.to_camera(r, t, p))
    m = C.projection_matrix(cam, r, t)
    h = [m[i][0] * p[0] + m[i][1] * p[1] + m[i][2] * p[2] + m[i][3] for i in range(3)]
    assert list(one(spark, u, v, h[0] / h[2], h[1] / h[2])) == pytest.approx([123, 456, 123, 456])


def test_lens_round_trip(spark):
    lens = C.Pinhole(1200, 1200, 600, 500, 1200, 1000, k1=-0.1, k2=0.02, p1=0.001, p2=0.002)
    seen = lens.distorted(F.lit(700.0), F.lit(300.0))
    assert list(one(spark, *lens.undistorted(*seen))) == pytest.approx([700, 300], abs=1e-3)


def test_camera_resize():
    cam = C.Pinhole(1200, 1200, 600, 500, 1200, 1000)
    half = cam.resized(0.5)
    assert (half.fx, half.cx, half.width, half.height) == (600, 300, 600, 500)
    with pytest.raises(ValueError):
        cam.resized(0)
    with pytest.raises(ValueError):
        cam.resized_to(600, 1000)


def test_baseline(spark):
    a, b = [tuple(F.lit(float(x)) for x in v) for v in ((350, 600, 120), (800, 100, 450))]
    assert one(spark, C.distance(a, b))[0] == pytest.approx(749.266, abs=0.01)


def test_elevation_angle_overhead(spark):
    eye, under, aside = ((F.lit(0.0), F.lit(0.0), F.lit(10.0)), (F.lit(0.0), F.lit(0.0), F.lit(0.0)), (F.lit(10.0), F.lit(0.0), F.lit(0.0)))
    got = one(spark, C.elevation_angle(eye, under), C.elevation_angle(eye, aside))
    assert got[0] == pytest.approx(90 * math.pi / 3.1415) and got[1] == pytest.approx(45 * math.pi / 3.1415)
