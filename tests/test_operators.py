"""Operators against sequential models and the constants of small cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions.camera import Pinhole
from skylattice.operators import algebra, depth, export, georef, mosaic, spatial, stages, tiles

CELL = "gx long, gy long, elevation double, angle double"


def grid(spark, rows):
    return spark.createDataFrame(rows, "gx long, gy long, v double, flag int")


def test_upsert_and_fill(spark):
    a, b = grid(spark, [(0, 0, 1.0, 0), (1, 0, None, 7)]), grid(spark, [(1, 0, 5.0, 9), (2, 0, 6.0, 1), (0, 0, None, 3)])
    rows = lambda df: sorted(tuple(r) for r in df.select("gx", "v", "flag").collect())
    assert rows(algebra.upsert(a, b)) == [(0, None, 3), (1, 5.0, 9)]
    assert rows(algebra.upsert(a, b, extend=True)) == [(0, None, 3), (1, 5.0, 9), (2, 6.0, 1)]
    assert rows(algebra.fill(a, b, extend=True, zero=("flag",))) == [(0, 1.0, 3), (1, 5.0, 7), (2, 6.0, 1)]


def test_overlap_of_two_maps(spark):
    cells = lambda x0, y0: spark.range(21 * 31).select((F.col("id") % 21 + x0).alias("gx"), (F.floor(F.col("id") / 21) + y0).alias("gy"), F.lit(1.0).alias("v"))
    both = algebra.overlap(cells(0, 0), cells(10, 15))
    got = both.agg(F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy"), F.count(F.lit(1))).first()
    assert tuple(got) == (10, 20, 15, 30, 11 * 16)


def test_bilinear_refinement_is_linear(spark):
    plane = spark.range(36).select((F.col("id") % 6).alias("gx"), F.floor(F.col("id") / 6).alias("gy")).withColumn("v", F.col("gx") * 2.0 + F.col("gy") * 3.0)
    fine = algebra.refine_bilinear(plane, 4).collect()
    assert len(fine) == 21 * 21 and all(r.v == pytest.approx(r.gx / 2 + r.gy * 0.75) for r in fine)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq long, gx long, gy long, color double, elevation double, angle double, elevated int")
    assert mosaic.blend(none).count() == mosaic.last_write(none).count() == mosaic.merge_latest(none).count() == 0
    empty = spark.createDataFrame([], "x double, y double, z double")
    assert spatial.idw_surface(empty, 1.0, 4, (0, 0, 3, 3)).count() == 0
    q = spark.createDataFrame([(1, 0.0, 0.0)], "qid long, qx double, qy double")
    assert spatial.nearest(q, empty, 2, 1.0).count() == 0


def fold(rows):
    """The sequential mosaic."""
    state = {}
    for seq, gx, gy, color, elevation, angle in sorted(rows):
        if elevation is None or angle <= 0:
            continue
        old = state.get((gx, gy))
        if old is None:
            state[gx, gy] = (color, elevation, angle, 1)
        elif angle > old[2]:
            state[gx, gy] = (color, elevation, angle, old[3] + 1)
    return state


def test_mosaic_is_the_fold(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), rng.randrange(3), float(rng.randrange(99)), None if rng.random() < 0.1 else float(rng.randrange(50)), float(rng.randrange(6))) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, gx long, gy long, color double, elevation double, angle double")
    got = {(r.gx, r.gy): (r.color, r.elevation, r.angle, r.n_obs) for r in mosaic.blend(df).collect()}
    assert got == fold(rows)


def test_tile_blend_prefers_reconstructed_cells(spark):
    schema = "gx long, gy long, color double, elevation double, angle double, elevated int"
    old = spark.createDataFrame([(0, 0, 1.0, 5.0, 80.0, 255), (1, 0, 1.0, 5.0, 80.0, 0), (2, 0, 1.0, None, 80.0, 0), (3, 0, 1.0, 5.0, 50.0, 0)], schema)
    new = spark.createDataFrame([(0, 0, 2.0, 6.0, 10.0, 0), (1, 0, 2.0, 6.0, 80.0, 0), (2, 0, 2.0, 6.0, 10.0, 255), (4, 0, 2.0, 6.0, 1.0, 0)], schema)
    got = {r.gx: r.color for r in mosaic.blend_tiles(new, old).collect()}
    assert got == {0: 2.0, 1: 1.0, 2: 2.0, 3: 1.0, 4: 2.0}


def ring_idw(points, x, y, res, rounds):
    """Sequential search by growing rings."""
    for i in range(1, rounds):
        near = [(z, (px - x) ** 2 + (py - y) ** 2) for px, py, z in points if (px - x) ** 2 + (py - y) ** 2 < i * res]
        if len(near) >= 3:
            hit = [z for z, d in near if d == 0]
            return sum(hit) / len(hit) if hit else sum(z / d for z, d in near) / sum(1 / d for _, d in near)
    return None


def test_idw_is_the_ring_search(spark):
    rng = random.Random(3)
    pts = [(rng.uniform(0, 12), rng.uniform(0, 12), rng.uniform(0, 9)) for _ in range(150)] + [(4.0, 4.0, 2.0)] * 2
    got = {(r.gx, r.gy): r.z for r in spatial.idw_surface(spark.createDataFrame(pts, "x double, y double, z double"), 1.0, 6, (0, 0, 12, 12)).collect()}
    for gx in range(13):
        for gy in range(13):
            want = ring_idw(pts, gx, gy, 1.0, 6)
            assert (got.get((gx, gy)) is None) == (want is None) and (want is None or got[gx, gy] == pytest.approx(want))


def test_nearest_is_exact_when_points_are_far(spark):
    rng = random.Random(8)
    pts = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(40)]
    qs = [(i, rng.uniform(-50, 150), rng.uniform(0, 100)) for i in range(25)]
    got = spatial.nearest(spark.createDataFrame(qs, "qid long, qx double, qy double"), spark.createDataFrame(pts, "x double, y double"), 3, 2.0).collect()
    by = {}
    for r in got:
        by.setdefault(r.qid, []).append(r.d2)
    for i, x, y in qs:
        assert sorted(by[i]) == pytest.approx(sorted((a - x) ** 2 + (b - y) ** 2 for a, b in pts)[:3])


def test_radius_join_is_the_theta_join(spark):
    rng = random.Random(4)
    pts = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(200)]
    qs = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(30)]
    n = spatial.radius_join(spark.createDataFrame(qs, "qid long, qx double, qy double"), spark.createDataFrame(pts, "x double, y double"), 1.3).count()
    assert n == sum((a - x) ** 2 + (b - y) ** 2 < 1.69 for _, x, y in qs for a, b in pts)


def test_plane_fits(spark):
    tilted = spark.createDataFrame([(float(x), float(y), float(x)) for x in range(4) for y in range(4)], "x double, y double, z double")
    row = spatial.fit_planes(spatial.plane_moments(tilted.withColumn("g", F.lit(1)), "g")).first()
    assert (row.nx, row.ny, row.nz) == pytest.approx((-(0.5**0.5), 0.0, 0.5**0.5))
    p = [tuple(F.lit(float(v)) for v in t) for t in ((0, 0, 0), (1, 0, 1), (0, 1, 0))]
    n = spark.range(1).select(*spatial.plane_of_three(*p)).first()
    assert list(n) == pytest.approx([-(0.5**0.5), 0.0, 0.5**0.5])


def test_depth_statistics(spark):
    rows = [(1, r, c, 33.333) for r in range(10) for c in range(12)]
    rows[5], rows[17] = (1, 0, 5, 66.666), (1, 1, 5, 11.111)
    got = depth.stats(spark.createDataFrame(rows, "frame_id long, r int, c int, depth double")).first()
    assert (got.min_depth, got.median_depth, got.max_depth) == (11.111, 33.333, 66.666)


def test_tilted_depth_map(spark):
    cam = Pinhole(1200, 1200, 600, 500, 1200, 1000)
    rows = [(1, r, c, 1800.0 - c) for r in range(3) for c in range(0, 1200)]
    df = spark.createDataFrame(rows, "frame_id long, r int, c int, depth double")
    n = depth.normals(df).first()
    assert (n.nx, n.ny, n.nz) == pytest.approx((0.5**0.5, 0.0, 0.5**0.5))
    back = depth.from_points(depth.reproject(df, cam).withColumn("point_id", F.col("c")), cam)
    assert {(r.r, r.c): r.depth for r in back.collect()}[0, 0] == pytest.approx(1800)


def test_consistency_votes(spark):
    rows = [(f, 0, 0, 10.0 if f != 2 else 20.0) for f in range(4)]
    got = {r.frame_id: (r.n_votes, r.kept) for r in depth.votes(spark.createDataFrame(rows, "frame_id long, r int, c int, depth double")).collect()}
    assert got == {0: (1, False), 1: (1, False), 2: (0, False), 3: (1, False)}


def test_umeyama_finds_the_similarity(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    v = rng.normal(size=(50, 3))
    g = 3.5 * v @ q.T + np.array([10.0, -4.0, 2.0])
    df = spark.createDataFrame([(1, i, *map(float, g[i]), *map(float, v[i])) for i in range(50)], "camera_id long, seq long, gx double, gy double, gz double, vx double, vy double, vz double")
    r = georef.umeyama(df).first()
    assert r.scale == pytest.approx(3.5) and [r.tx, r.ty, r.tz] == pytest.approx([10, -4, 2])
    assert np.allclose([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)], q)


def test_throttle_and_sessions(spark):
    rows = [(1, i, i, float(i * 4), 0.0, 10.0, 10.0, int(i not in (2, 3, 5))) for i in range(8)]
    f = spark.createDataFrame(rows, "camera_id long, frame_id long, ts long, x double, y double, width double, height double, has_pose int")
    assert [r.frame_id for r in stages.throttled(f, 30.0).orderBy("frame_id").collect()] == [0, 2, 4, 6]
    assert [r.session for r in stages.lost_sessions(f, 2).orderBy("frame_id").collect()] == [0, 0, 0, 0, 0, 1, 1, 1]
    lost = f.withColumn("has_pose", F.lit(0))
    assert [r.session for r in stages.lost_sessions(lost, 2).orderBy("frame_id").collect()] == [0, 0, 1, 1, 1, 2, 2, 2]  # every third lost frame resets
    assert [r.session for r in stages.lost_sessions(lost, 2, F.col("frame_id") >= 4).orderBy("frame_id").collect()] == [0, 0, 1, 1, 1, 1, 1, 1]
    assert [r.frame_id for r in stages.keep_latest(f, 2).orderBy("frame_id").collect()] == [6, 7]


def test_pyramid_levels_agree(spark):
    rng = random.Random(1)
    pts = spark.createDataFrame([(rng.uniform(0, 9e4), rng.uniform(0, 9e4), float(i)) for i in range(300)], "mx double, my double, z double")
    sums = tiles.pyramid(pts, 8, 14).groupBy("zoom").agg(F.sum("n").alias("n"), F.sum(F.col("z") * F.col("n")).alias("t")).collect()
    assert len(sums) == 7 and all(r.n == 300 and r.t == pytest.approx(300 * 299 / 2) for r in sums)
    with pytest.raises(ValueError):
        tiles.pyramid(pts, 9, 8)


def test_tiles_written_by_zoom(spark, tmp_path):
    pts = spark.createDataFrame([(10.0 * i, 20.0 * i, float(i)) for i in range(50)], "mx double, my double, z double")
    tiles.write_tiles(tiles.pyramid(pts, 10, 12), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("zoom = 11").count() > 0
    assert (tmp_path / "t" / "zoom=12").is_dir()


def test_mesh_and_smoothing(spark):
    cells = spark.range(12).select((F.col("id") % 4).alias("gx"), F.floor(F.col("id") / 4).alias("gy"), F.lit(2.0).alias("v"))
    assert export.mesh(cells).count() == 2 * 3 * 2
    assert {r.v for r in spatial.smooth(cells, "v").collect()} == {2.0}
    assert {round(r.v, 9) for r in spatial.smooth(cells, "v", kind="bilateral").collect()} == {2.0}


def test_scale_drift_samples_the_earlier_measurements(spark):
    rows = [(1, i, 20.0 * i, 0.0, 0.0, (20.0 * i) / (2.0 + 0.1 * i), 0.0, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "camera_id long, seq long, gx double, gy double, gz double, vx double, vy double, vz double")
    scales = [(100 - 20 * i) / abs(100 / 2.5 - 20 * i / (2.0 + 0.1 * i)) for i in range(5)]  # five earlier ones: every one is sampled
    assert georef.scale_drift(df, 2.0, 1.0).first().drift == pytest.approx(abs(1 - sum(scales) / 5 / 2.0) * 100)


def test_smoothing_keeps_frames_apart(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SQUARE", 3)
    import math
    import statistics

    rng = random.Random(8)
    rows = [(f, x, y, float(rng.randrange(100) + 1000 * f)) for f in range(3) for x in range(6) for y in range(5) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "frame_id long, gx long, gy long, v double")
    for kind in ("median", "bilateral"):
        want = {}
        for f, x, y, v in rows:
            near = [(a - x, b - y, u) for g, a, b, u in rows if g == f and abs(a - x) <= 2 and abs(b - y) <= 2]
            w = [math.exp(-(i * i + j * j) / 1250 - (u - v) ** 2 / 1250) * (i * i + j * j <= 4) for i, j, u in near]
            want[f, x, y] = statistics.median(u for _, _, u in near) if kind == "median" else sum(k * u for k, (_, _, u) in zip(w, near, strict=True)) / sum(w)
        got = {(r.frame_id, r.gx, r.gy): r.v for r in spatial.smooth(cells, "v", kind=kind, by=("frame_id",)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_warp_keeps_values(spark):
    cells = spark.range(400).select((60400 + F.col("id") % 20).alias("gx"), (579200 + F.floor(F.col("id") / 20)).alias("gy"), (F.col("id") * 1.0).alias("elevation"))
    got = tiles.warp_to_mercator(cells, 10.0, 32, "elevation", 10.0).collect()
    assert len(got) > 900 and {r.elevation for r in got} == {float(i) for i in range(400)}


def test_georeference_difference():
    turn = lambda a, s, t: np.array([[s * np.cos(a), -s * np.sin(a), 0, t], [s * np.sin(a), s * np.cos(a), 0, -t], [0, 0, s, 2 * t], [0, 0, 0, 1]])
    old, new = turn(0.3, 2.0, 5.0), turn(0.5, 3.0, 6.0)
    d = georef.georeference_difference(old, new)
    d[:3, :3] /= 1.5
    assert np.allclose(georef.without_scale(old)[0] @ d, georef.without_scale(new)[0])
    with pytest.raises(ValueError):
        georef.without_scale(np.zeros((4, 4)))
