"""The stage chains, the georeference chain, tags and files against models and known answers."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions.camera import Pinhole
from skylattice.operators import algebra, export, georef, mosaic, rectify, spatial, stages, surface, tiles
from skylattice.operators import depth as D
from skylattice.sources import files, images, tags

POSE = "camera_id long, seq long, " + ", ".join(f"{c} double" for c in (*georef.GIS, *georef.VIS, *georef.GROT, *georef.VROT))


def transform(size, x, y, z):
    return [size, 0.0, 0.0, x, 0.0, size, 0.0, y, 0.0, 0.0, size, z, 0.0, 0.0, 0.0, 1.0]


def depths(spark, cloud, z):
    """min, median and max depth under a camera that looks down from z."""
    r = D.scene_depth(cloud, (0.0, 0.0, -1.0), z).first()
    return r.min_depth, r.median_depth, r.max_depth


def test_georeference_moves_pose_and_cloud(spark):
    pose = dict(zip(georef.VIS, (500.0, 600.0, 1200.0), strict=True)) | dict(zip(georef.VROT, (0, 1, 0, 1, 0, 0, 0, 0, -1), strict=True))
    frame = spark.createDataFrame([(1, 1, *(float(pose.get(c, 0.0)) for c in (*georef.GIS, *georef.VIS, *georef.GROT, *georef.VROT)))], POSE)
    cloud = spark.createDataFrame([(0.0, 32.0, 0.0), (15.0, 50.0, -1200.0), (2.0, 2.0, 600.0)], "x double, y double, z double")
    first, higher = transform(1 / 12, 603976.0, 5791569.0, 50.0), transform(1 / 12, 603976.0, 5791569.0, 100.0)
    square = lambda t: [t[4 * i : 4 * i + 4] for i in range(4)]
    height = lambda t: georef.georeferenced(frame, spark.createDataFrame([(1, t)], "camera_id long, t array<double>")).first()
    diff = georef.georeference_difference(np.eye(4), square(first))
    moved = georef.apply_transform(cloud, diff.tolist())
    got = height(first)
    assert got.gz == pytest.approx(150) and [got.g01, got.g10, got.g22] == pytest.approx([1, 1, -1])
    assert depths(spark, moved, 150.0) == pytest.approx((50, 100, 200), abs=1e-2)
    assert height(higher).gz == pytest.approx(200) and depths(spark, moved, 200.0) == pytest.approx((100, 150, 250), abs=1e-2)
    again = georef.apply_transform(moved, georef.georeference_difference(square(first), square(higher)).tolist())
    assert depths(spark, again, 200.0) == pytest.approx((50, 100, 200), abs=1e-2)


def track(n, scale, straight, camera=1):
    """Measurements whose GNSS pose is the visual one turned, scaled and moved; the track may be a straight line."""
    a = 0.4
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    rows = []
    for i in range(n):
        v = np.array([5.0 * i, 0.0 if straight else 3.0 * (i % 3), 0.0])
        down = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, -1]])
        g = scale * turn @ v + np.array([1000.0, 2000.0, 100.0])
        rows.append((camera, i, *map(float, g), *map(float, v), *map(float, (turn @ down).ravel()), *map(float, down.ravel())))
    return rows, turn


@pytest.mark.parametrize("straight", [False, True])
def test_georef_chain_finds_the_similarity(spark, straight):
    rows, turn = track(8, 4.0, straight)
    poses = spark.createDataFrame(rows, POSE)
    report, kept, fitted = georef.georef_init(poses.where("seq < 7"), 1.0, 5)
    r = report.first()
    assert r.stands and r.n_unique == 7 and r.scale == pytest.approx(4.0) and kept.count() == 7
    more, updated = georef.georef_update(kept, poses.where("seq = 7"), fitted, 1.0)
    assert more.count() == 8
    t = np.array(updated.first().t).reshape(4, 4)
    for row in rows:
        assert np.allclose((t @ np.array([*row[5:8], 1.0]))[:3], row[2:5], atol=0.6)
    assert np.allclose(t[:3, :3] / np.linalg.norm(t[:3, 0]), turn, atol=0.02)  # a straight track doesn't turn about itself
    assert not georef.georef_init(poses, 1.0, 9)[0].first().stands
    assert not georef.georef_init(poses, 1.0, 5, most_change=0.5)[0].first().stands


def test_unique_measurements_and_their_scales(spark):
    rng = random.Random(4)
    rows = [(c, i, *(rng.uniform(0, 60) for _ in range(3)), *(rng.uniform(0, 15) for _ in range(3))) for c in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "camera_id long, seq long, gx double, gy double, gz double, vx double, vy double, vz double")
    want, sums = [], {1: [0.0, 0], 2: [0.0, 0]}
    for c in (1, 2):
        chosen = []
        for r in [r for r in rows if r[0] == c]:
            for o in reversed(chosen):
                g, v = math.dist(r[2:5], o[2:5]), math.dist(r[5:], o[5:])
                if g <= 10 or v <= 2:
                    break
                sums[c][0] += g / v
                sums[c][1] += 1
            else:
                chosen.append(r)
                want.append((c, r[1]))
    got = georef.judged_unique(df.repartition(3), 2.0).collect()
    assert sorted((r.camera_id, r.seq) for r in got if r.chosen) == want
    for c in (1, 2):
        assert sum(r.total for r in got if r.camera_id == c) == pytest.approx(sums[c][0]) and sum(r.n for r in got if r.camera_id == c) == sums[c][1]


def test_publishing(spark):
    rows = [(1, i, i, float(x), 0.0, 10.0, 10.0, k, p) for i, (x, k, p) in enumerate([(0, 1, 1), (2, 1, 1), (8, 1, 1), (9, 0, 0), (16, 0, 0), (16, 1, 1), (30, 0, 1)])]
    f = spark.createDataFrame(rows, "camera_id long, frame_id long, ts long, x double, y double, width double, height double, is_keyframe int, has_pose int")
    got = lambda **how: [(r.frame_id, r.why) for r in stages.published(f, 50.0, 50.0, **how).orderBy("frame_id").collect()]
    assert got() == [(0, "keyframe"), (2, "keyframe"), (5, "keyframe")]
    assert got(use_fallback=True) == [(0, "keyframe"), (2, "keyframe"), (4, "fallback")]
    assert got(use_tracker=False) == [(0, "gnss"), (2, "gnss"), (4, "gnss"), (6, "gnss")]
    c = stages.frame_counters(f.withColumn("n_newer", F.col("frame_id")), F.col("has_pose") == 1, 5).first()
    assert (c.n_total, c.n_bad, c.n_dropped, c.n_processed) == (7, 2, 2, 3)
    links = {r.frame_id: r.link for r in stages.keyframe_links(f, f.where("is_keyframe = 1").select("camera_id", "ts", F.col("frame_id").alias("keyframe_id"))).collect()}
    assert links == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5}


def test_surfaces_of_frames(spark):
    rng = random.Random(3)
    plane = lambda x, y: 0.5 * x - 0.25 * y + 7
    cloud = [(1, x, y, plane(x, y)) for x, y in ((rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(3000))]
    dense = spark.createDataFrame(cloud + [(2, 1.0, 1.0, 5.0)], "frame_id long, x double, y double, z double")
    sparse = spark.createDataFrame([(2, 1.0, 1.0, 3.0), (2, 2.0, 2.0, 9.0), (2, 2.0, 3.0, 4.0)], "frame_id long, x double, y double, z double")
    frames = spark.createDataFrame([(1, 2.5, 2.5, 10.0, 10.0, 1, 1), (2, 0.0, 0.0, 4.0, 3.0, 0, 1), (3, 0.0, 0.0, 1.0, 1.0, 1, 1)], "frame_id long, x double, y double, width double, height double, is_keyframe int, has_pose int")
    got = surface.frame_surfaces(frames, dense, sparse, 1.0, (0, 0, 20, 20)).collect()
    one = [r for r in got if r.frame_id == 1]
    assert len(one) == 100 and {r.assumption for r in one} == {"ELEVATION"} and all(abs(r.elevation - plane(r.gx, r.gy)) < 0.4 for r in one)
    assert sorted({(r.frame_id, r.elevation, r.assumption) for r in got if r.frame_id > 1}) == [(2, 4.0, "PLANAR"), (3, 0.0, "PLANAR")]
    assert len([r for r in got if r.frame_id == 2]) == 20
    assert {r.assumption for r in surface.assumptions(frames, dense, False).collect()} == {"PLANAR"}


@pytest.mark.parametrize("mode", ["nearest", "furthest", "best", "prior"])
def test_normals_of_a_plane(spark, mode):
    rng = random.Random(5)
    n = np.array([-0.5, 0.25, 1.0]) / np.linalg.norm([-0.5, 0.25, 1.0])
    pts = [(x, y, 0.5 * x - 0.25 * y, *map(float, n)) for x, y in ((rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(1500))]
    cloud = spark.createDataFrame(pts, "x double, y double, z double, nx double, ny double, nz double")
    got = surface.elevation_surface(cloud, 1.0, (2, 2, 10, 10), 5, mode).collect()
    assert len(got) == 81 and all(np.allclose([r.nx, r.ny, r.nz], n, atol=1e-6) for r in got)


def test_orthophoto_takes_the_pixel_that_shows_a_cell(spark):
    cam = Pinhole(50.0, 50.0, 10.3, 10.4, 20, 20)
    frames = spark.createDataFrame([(1, 5.0, 5.0, 50.0, 0.0), (2, 8.0, 5.0, 50.0, 90.0)], "frame_id long, easting double, northing double, altitude double, heading double")
    img = spark.createDataFrame([(f, r, c, f * 1000 + r * 20 + c) for f in (1, 2) for r in range(20) for c in range(20)], "frame_id long, r int, c int, color long")
    cells = spark.createDataFrame([(f, x, y, 0.0, "PLANAR") for f in (1, 2) for x in range(12) for y in range(12)] + [(1, 50, 50, 0.0, "PLANAR"), (1, 3, 3, None, "PLANAR")], "frame_id long, gx long, gy long, elevation double, assumption string")
    got = {(r.frame_id, r.gx, r.gy): r for r in rectify.orthophotos(frames, cells, img, cam, 1.0).collect()}
    assert (1, 50, 50) not in got
    for (f, x, y), r in got.items():
        u, v = ((x - 5) + 10.3, -(y - 5) + 10.4) if f == 1 else (-(y - 5) + 10.3, -(x - 8) + 10.4)
        assert r.color == f * 1000 + math.floor(v) * 20 + math.floor(u) and r.elevated == 255 and r.n_obs == 1
    blended = mosaic.blend(rectify.orthophotos(frames, cells, img, cam, 1.0).withColumn("seq", F.col("frame_id")))
    assert {r.gx for r in blended.collect()} == set(range(12))


def test_tiles_are_updated_in_place(spark, tmp_path):
    path = str(tmp_path / "tiles")
    row = lambda tx, px, color, angle: (11, tx, 5, px, 7, color, 1.0, angle, 0)
    schema = "zoom int, tx long, ty long, px long, py long, color double, elevation double, angle double, elevated int"
    tiles.write_tiles(spark.createDataFrame([row(1, 300, 1.0, 50.0), row(1, 301, 2.0, 50.0), row(9, 2400, 3.0, 50.0)], schema), path)
    tiles.update_tiles(spark, path, spark.createDataFrame([row(1, 300, 10.0, 60.0), row(1, 301, 20.0, 40.0), row(1, 302, 30.0, 1.0)], schema))
    got = {(r.tx, r.px): r.color for r in tiles.read_tiles(spark, path, 11).collect()}
    assert got == {(1, 300): 10.0, (1, 301): 2.0, (1, 302): 30.0, (9, 2400): 3.0}
    assert tiles.read_tiles(spark, path, 11, (2, 20), (0, 9)).count() == 1
    assert tiles.lookup(tiles.read_tiles(spark, path), spark.createDataFrame([(11, 9, 5)], "zoom int, tx long, ty long")).count() == 1
    assert {r.tx: r.n_bytes for r in tiles.tile_sizes(tiles.read_tiles(spark, path), 16).collect()} == {1: 48, 9: 16}
    m = tiles.tile_meters(spark.createDataFrame([(0, 1)], "tx long, ty long"), 1).first()
    assert (m.x, m.y, m.width) == pytest.approx((-20037508.342789244, 0.0, 20037508.342789244))


def triangle_area(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def test_mesh_over_a_mask_and_its_file(spark, tmp_path):
    files.register(spark)
    there = [(x, y) for x in range(7) for y in range(5) if (x, y) not in ((0, 0), (6, 0), (0, 4), (6, 4), (3, 2))]
    cells = spark.createDataFrame([(x, y, float(x + y), float(x * 30)) for x, y in there], "gx long, gy long, elevation double, red double").withColumns({"green": F.col("red"), "blue": F.lit(1.0)})
    faces = export.mesh_over_mask(cells.select("gx", "gy"))
    areas = [triangle_area(r.a, r.b, r.c) for r in faces.collect()]
    assert all(a == 1 for a in areas) and sum(areas) / 2 == 24 - 8 * 0.5  # each corner and the hole's four squares lose half a square
    v, f = export.indexed_mesh(cells, faces, 2.0, 4, ("red", "green", "blue"))
    export.mesh_rows(v, f).write.format("plymesh").mode("append").save(str(tmp_path / "m"))
    total = 0
    for p in (tmp_path / "m").glob("*.ply"):
        head, _, body = p.read_bytes().partition(b"end_header\n")
        n, m = (int(head.split(k)[1].split()[0]) for k in (b"element vertex ", b"element face "))
        assert len(body) == n * 15 + m * 13
        pts = np.frombuffer(body, np.dtype([("p", "<f4", 3), ("c", "u1", 3)]), n)
        sides = np.frombuffer(body, np.dtype([("n", "u1"), ("i", "<i4", 3)]), m, n * 15)
        assert (sides["n"] == 3).all() and sides["i"].max() < n and (pts["p"][:, 2] == (pts["p"][:, 0] + pts["p"][:, 1]) / 2).all()
        total += sum(triangle_area(*pts["p"][i, :2]) / 2 for i in sides["i"])
    assert total == 20 * 4 and len(list((tmp_path / "m").glob("*.ply"))) == 2


def test_matrix_files_and_sidecars(spark, tmp_path):
    files.register(spark)
    px = spark.createDataFrame([(f"d{k}", r, c, float(k * 100 + r * 4 + c) if (r, c) != (1, 1) else None) for k in range(3) for r in range(3) for c in range(4)], "name string, r long, c long, value double")
    px.repartition("name").sortWithinPartitions("name").write.format("matrix").mode("append").save(str(tmp_path / "x"))
    back = {(r.path[-6:-4], r.r, r.c): r.value for r in images.read_matrices(spark, str(tmp_path / "x")).collect()}
    assert len(back) == 36 and back["d2", 2, 3] == 211.0 and back["d0", 1, 1] is None
    cells = spark.createDataFrame([(2, 3), (5, 9)], "gx long, gy long")
    s = export.layer_sidecars(cells, 0.5, 32, "U").first()
    assert tuple(s.roi) == (1.0, 1.5, 1.5, 3.0) and (s.rows, s.cols, s.zone, s.band) == (7, 4, 32, "U")
    views = spark.createDataFrame([(1, 604010.0, 5792020.0, 3.0, [1, 2])], "point_id long, x double, y double, z double, views array<long>")
    f = spark.createDataFrame([(1, 604000.0, 5792000.0, 100.0, 5.0)], "frame_id long, easting double, northing double, altitude double, heading double")
    assert sorted(r.value for r in export.scene_lines(views, f).collect())[1] == '{"kind":"point","point_id":1,"x":10.0,"y":20.0,"z":3.0,"views":[1,2]}'


def test_resampling_by_layer(spark):
    cells = spark.createDataFrame([(x, y, float(x), x % 2) for x in range(6) for y in range(6)], "gx long, gy long, height double, flag long")
    got = {(r.gx, r.gy): r for r in algebra.resample(cells, 1.0, 0.5, {"height": "linear", "flag": "nearest"}).collect()}
    assert got[4, 4].height == 2.0 and got[5, 4].height == 2.5 and got[4, 4].flag == 0 and got[6, 4].flag == 1
    coarse = {(r.gx, r.gy): r.height for r in algebra.resample(cells, 1.0, 2.5, {"height": "nearest"}).collect()}
    assert coarse[0, 0] == 0.0 and coarse[1, 1] == 3.0 and coarse[2, 0] == 5.0
    with pytest.raises(ValueError):
        algebra.upsert(cells, cells, res=(1.0, 0.5))
    with pytest.raises(ValueError):
        algebra.resample(cells, 1.0, 0.5, {"height": "cubic"})


def test_tags_of_images(spark, tmp_path):
    packet = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:drone="http://example/drone/" drone:Yaw="45.5"><drone:Serial>S7</drone:Serial></rdf:Description></rdf:RDF></x:xmpmeta>'
    plain = b"\xff\xd8" + packet + b"\xff\xd9"
    (tmp_path / "img_0042.jpg").write_bytes(plain)
    base = spark.createDataFrame([(bytearray(plain), "CAM", "2024:01:02 03:04:05", -52.2625, 10.5125, 120.5, 270.25)], "content binary, camera_id string, timestamp string, latitude double, longitude double, altitude double, heading double")
    once = bytes(tags.with_exif(base).first().content)
    assert bytes(tags.with_exif(base.withColumn("content", F.lit(once))).first().content) == once
    (tmp_path / "img_0043.jpg").write_bytes(once)
    got = {r.frame_id: r for r in tags.read_tagged_frames(spark, str(tmp_path)).collect()}
    assert got[42].camera_id == "unknown_id" and got[42].latitude == 0.0
    r = got[43]
    assert (r.camera_id, r.timestamp) == ("CAM", "2024:01:02 03:04:05") and (r.latitude, r.longitude, r.altitude, r.heading) == pytest.approx((-52.2625, 10.5125, 120.5, 270.25))
    assert (r.zone, r.band) == (32, "F") and r.easting == pytest.approx(603237, abs=500)
    own = tags.load_tags('heading: "Xmp.drone.Yaw"\ncamera_id: "Xmp.drone.Serial"\n')
    named = {x.frame_id: x for x in tags.read_tagged_frames(spark, str(tmp_path), tags=own).collect()}
    assert named[42].camera_id == "S7" and named[42].heading == 45.5
    there = {x.path[-6:-4]: x.tags for x in tags.probed(spark, str(tmp_path), tags=own).collect()}
    assert len(there["42"]) == 8 and sum(there["42"].values()) == 2 and all(there["43"].values())
    assert tags.is_xmp("Xmp.drone.Yaw") and not tags.is_xmp("Exif.Image.Model") and tags.tags_of(struct.pack("<4I", 1, 2, 3, 4)) == {}


def test_rising_parts_give_the_same_mosaic(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), 0, float(i), 1.0, rng.random() * 90) for i in range(900)]
    obs = spark.createDataFrame(rows, "seq long, gx long, gy long, color double, elevation double, angle double")
    want = {}
    for i, gx, _, color, _, angle in rows:
        best = want.setdefault(gx, [0.0, None, 0])
        if angle > best[0]:
            want[gx] = [angle, color, best[2] + 1]
    assert {r.gx: [r.angle, r.color, r.n_obs] for r in mosaic.blend(obs.repartition(5)).collect()} == want


def test_ground_sampling_distance_is_that_of_a_grid(spark):
    grid = spark.createDataFrame([(x * 0.5, y * 0.5) for x in range(40) for y in range(40)], "x double, y double")
    assert spatial.ground_sampling_distance(grid, 5).first().gsd == pytest.approx(0.5)


def test_maps_carry_their_resolution(spark):
    from skylattice.operators import algebra

    fine = algebra.with_resolution(spark.createDataFrame([(x, y, float(x + y)) for x in range(8) for y in range(8)], "gx long, gy long, v double"), 0.5)
    coarse = algebra.resample_area(fine, 2)
    assert [algebra.resolution_of(m) for m in (coarse, algebra.resample_nearest(fine, 4), algebra.refine_bilinear(fine, 2), algebra.resample_to(fine, 0.5, 2.0, "v"))] == [1.0, 2.0, 0.25, 2.0]
    for join in (algebra.overlap, algebra.upsert, algebra.fill):
        with pytest.raises(ValueError, match="differ"):
            join(fine, coarse)
        assert join(coarse, algebra.with_resolution(coarse, 1.0)).count() == join(coarse, spark.createDataFrame(coarse.collect())).count() == 16


def test_resampling_to_another_resolution_takes_wide_maps_whole(spark):
    """Every node of the finer lattice whose nearest cell is there, far beyond the first strip of a map."""
    cells = {(x, y): float(x + y) for x in (0, 1, 79, 80, 81, 640, 641, 9599) for y in range(-2, 3)}
    got = {(r.gx, r.gy): r.v for r in algebra.resample_to(spark.createDataFrame([(*k, v) for k, v in cells.items()], "gx long, gy long, v double"), 2.5, 1.0, "v").collect()}
    near = lambda i: math.floor(i / 2.5 + 0.5)
    want = {(x, y): cells[near(x), near(y)] for x in range(-10, 24100) for y in range(-10, 11) if (near(x), near(y)) in cells}
    assert got == want and max(x for x, _ in got) > 23_000
