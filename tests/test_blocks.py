"""Block rasters and what is resampled on them, against scalar models."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.camera import Pinhole
from skylattice.operators import blocks as B
from skylattice.operators import imaging


def cells_of(spark, values, x0=0, y0=0, layers=("v",)):
    """A table of the cells of {(x, y): value or tuple of values}."""
    rows = [(x + x0, y + y0, *(v if isinstance(v, tuple) else (v,))) for (x, y), v in values.items()]
    return spark.createDataFrame(rows, "gx long, gy long, " + ", ".join(f"{c} double" for c in layers))


def found(blocks, layers=("v",), by=()):
    return {tuple(r)[: len(by) + 2]: tuple(r)[len(by) + 2 :] for r in B.to_cells(blocks, list(layers), by).collect()}


def weights(kernel, f):
    if kernel == "nearest":
        return {0: 1.0}
    if kernel == "bilinear":
        return {0: 1 - f, 1: f}

    def w(d):
        a = -0.75
        return (a + 2) * d**3 - (a + 3) * d**2 + 1 if d <= 1 else a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a

    return {k: w(abs(f - k)) for k in (-1, 0, 1, 2)}


def sample(values, u, v, kernel, ext, border="edge", holes="spread"):
    """A place of a raster {(x, y): value}, tap by tap."""

    def at(x, y):
        inside = ext.x <= x < ext.x + ext.width and ext.y <= y < ext.y + ext.height
        if border == "edge":
            x, y = min(max(x, ext.x), ext.x + ext.width - 1), min(max(y, ext.y), ext.y + ext.height - 1)
        elif not inside:
            return None
        return values.get((x, y))

    bx, by = (math.floor(z + 0.5) if kernel == "nearest" else math.floor(z) for z in (u, v))
    taps = [(wx * wy, at(bx + i, by + j)) for j, wy in weights(kernel, v - by).items() for i, wx in weights(kernel, u - bx).items()]
    if all(x is not None for w, x in taps if w):
        return sum(w * x for w, x in taps if w)
    if holes == "spread" or kernel == "nearest" or at(math.floor(u + 0.5), math.floor(v + 0.5)) is None:
        return None
    if kernel == "cubic":
        return sample(values, u, v, "bilinear", ext, border, holes)
    return sum(w * x for w, x in taps if x is not None) / sum(w for w, x in taps if x is not None)


def same(got, want):
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


def random_raster(width, height, holes=0.1, seed=1):
    rng = random.Random(seed)
    return {(x, y): rng.uniform(-5, 5) for x in range(width) for y in range(height) if rng.random() >= holes}


def test_cells_and_blocks_come_back(spark):
    values = random_raster(150, 70)
    cells = cells_of(spark, values, -90, -30).withColumn("w", F.when(F.col("gx") % 3 == 0, F.col("v") * 2)).withColumns({"frame_id": F.col("gx") % 2, "tx": F.lit("clash")})
    blocks = B.to_blocks(cells.drop("tx"), ["v", "w"], ("frame_id",))
    assert found(blocks, ("v", "w"), ("frame_id",)) == {(r.frame_id, r.gx, r.gy): (r.v, r.w) for r in cells.collect()}
    assert blocks.count() == 2 * len({(x - 90 >> 6, y - 30 >> 6) for x, y in values})
    assert B.to_blocks(cells.limit(0).drop("tx"), ["v"]).count() == 0 and B.extent_of(cells.limit(0)) == B.Extent(0, 0, 0, 0)
    assert B.extent_of(cells) == B.Extent(-90, -30, 150, 70)


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize(("width", "height"), [(259, 139), (53, 29)])
def test_changed_size(spark, kernel, width, height):
    values = random_raster(130, 70, 0.02)
    values = {(x - 40, y - 100): v for (x, y), v in values.items()}
    source, target = B.Extent(-40, -100, 130, 70), B.Extent(-40, -100, width, height)
    got = found(B.changed_size(B.to_blocks(cells_of(spark, values), ["v"]), ["v"], source, target, kernel))
    want = {}
    for x in range(width):
        for y in range(height):
            value = sample(values, (x + 0.5) * 130 / width - 0.5 - 40, (y + 0.5) * 70 / height - 0.5 - 100, kernel, source)
            if value is not None:
                want[x - 40, y - 100] = value
    same(got, want)


def test_sizes_change_alike(spark):
    assert B.Extent(0, 0, 41, 61).resized(21, 31) == B.Extent(0, 0, 21, 31)
    with pytest.raises(ValueError, match="differently"):
        B.Extent(0, 0, 41, 61).resized(21, 61)
    with pytest.raises(ValueError, match="fewer"):
        B.shrunk(B.to_blocks(cells_of(spark, {(0, 0): 1.0}), ["v"]), ["v"], B.Extent(0, 0, 1, 1), B.Extent(0, 0, 2, 1))


@pytest.mark.parametrize(("width", "height"), [(41, 23), (130, 70), (1, 1), (3, 69)])
def test_area_means(spark, width, height):
    values = {(x + 7, y - 9): v for (x, y), v in random_raster(130, 70, 0.3).items()}
    source = B.Extent(7, -9, 130, 70)
    got = found(B.changed_size(B.to_blocks(cells_of(spark, values), ["v"]), ["v"], source, B.Extent(7, -9, width, height), "area"))
    kx, ky = 130 / width, 70 / height
    sums: dict = {}
    for (x, y), v in values.items():
        x, y = x - 7, y + 9
        for i in range(int(x / kx), min(width, math.ceil((x + 1) / kx))):
            for j in range(int(y / ky), min(height, math.ceil((y + 1) / ky))):
                w = max(0, min(x + 1, (i + 1) * kx) - max(x, i * kx)) * max(0, min(y + 1, (j + 1) * ky) - max(y, j * ky))
                t, n = sums.get((i + 7, j - 9), (0, 0))
                sums[i + 7, j - 9] = t + w * v, n + w
    same(got, {k: t / n for k, (t, n) in sums.items() if n > 1e-9})


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "cubic"])
def test_turned_map_with_holes(spark, kernel):
    """A map turned by 30 degrees, with the rule of warping: taps that have a value, where the nearest cell has one."""
    values = random_raster(140, 90, 0.2)
    source, target = B.Extent(0, 0, 140, 90), B.Extent(-70, -20, 200, 150)
    c, s = math.cos(0.5), math.sin(0.5)
    place = lambda x, y: (c * x + s * y + 3, c * y - s * x + 2)
    rows = B.target_blocks(spark.range(1).select(), target)
    got = found(B.resampled(B.to_blocks(cells_of(spark, values), ["v"]), ["v"], rows, lambda x, y, _: place(x, y), source, target, kernel, "empty", "skip"))
    want = {}
    for x in range(-70, 130):
        for y in range(-20, 130):
            value = sample(values, *place(x, y), kernel, source, "empty", "skip")
            if value is not None:
                want[x, y] = value
    same(got, want)


def test_resampling_moves_blocks_not_cells(spark):
    got = B.changed_size(B.to_blocks(cells_of(spark, random_raster(300, 200, 0)), ["v"]), ["v"], B.Extent(0, 0, 300, 200), B.Extent(0, 0, 599, 399), "cubic")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    assert got.count() == 10 * 7


LENS = Pinhole(90.0, 95.0, 70.0, 45.0, 140, 90, -0.2, 0.05, 0.002, -0.001, 0.01)


def test_undistorted_images(spark):
    """An image that shows its own ideal pixel numbers is straight again; a null pixel empties those beside it."""
    pixels = spark.range(140 * 90).select((F.col("id") % 140).alias("gx"), F.floor(F.col("id") / 140).alias("gy"))
    ideal = LENS.undistorted(F.col("gx"), F.col("gy"), 40)
    frames = pixels.withColumns({"frame_id": F.lit(None).cast("long"), "u": ideal[0], "v": ideal[1]}).unionByName(
        pixels.withColumns({"frame_id": F.lit(7).cast("long"), "u": F.when(F.col("gx") != 70, 1.0), "v": F.lit(2.0)})
    )
    got = found(imaging.undistorted_images(B.to_blocks(frames, ["u", "v"], imaging.FRAME), ["u", "v"], LENS), ("u", "v"), imaging.FRAME)
    one = {k[1:]: v for k, v in got.items() if k[0] is None}
    assert len(one) > 0.9 * 140 * 90 and all(abs(u - x) < 0.01 and abs(v - y) < 0.01 for (x, y), (u, v) in one.items())
    two = {k[1:]: v for k, v in got.items() if k[0] == 7}
    assert 0 < sum(u is None for u, _ in two.values()) < 4 * 90 and all(abs(v - 2) < 1e-12 for _, v in two.values())


def rotation(rng, size=0.2):
    a, b, c = (rng.uniform(-size, size) for _ in range(3))
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    return rx @ ry @ rz @ np.diag([1.0, -1.0, -1.0])


def struct_of(place, turn):
    return (*map(float, place), *map(float, turn.ravel()))


POSE = "struct<x:double,y:double,z:double," + ",".join(f"r{i}{j}:double" for i in range(3) for j in range(3)) + ">"


def test_rectified_pairs_have_places_in_one_row(spark):
    rng = random.Random(3)
    poses = [((rng.uniform(0, 9), rng.uniform(0, 9), 80 + rng.uniform(0, 3)), rotation(rng)) for _ in range(16)]
    rows = [(k, 2 * k, 2 * k + 1, struct_of(*poses[2 * k]), struct_of(*poses[2 * k + 1])) for k in range(8)]
    rows += [(8, 0, 0, rows[0][3], rows[0][3]), (9, 0, 1, struct_of((0, 0, 9), np.diag([1.0, -1.0, -1.0])), struct_of((0, 0, 5), np.diag([1.0, -1.0, -1.0])))]
    pairs = spark.createDataFrame(rows, f"pair_id long, left_id long, right_id long, left {POSE}, right {POSE}")
    got = {r.pair_id: r for r in imaging.rectification(pairs, LENS).collect()}
    assert sorted(got) == list(range(8))  # no baseline, or one along the view
    flat = imaging.rectified_camera(LENS)
    for k, r in got.items():
        turns = [np.array(t).reshape(3, 3) for t in (r.left_turn, r.right_turn)]
        q = np.array(r.q).reshape(4, 4)
        for t in turns:
            assert np.allclose(t @ t.T, np.eye(3)) and np.linalg.det(t) > 0
        for _ in range(20):
            ground = np.array([rng.uniform(-30, 40), rng.uniform(-30, 40), rng.uniform(0, 10)])
            seen = []
            for (place, turn), t in zip((poses[2 * k], poses[2 * k + 1]), turns, strict=True):
                p = t.T @ (turn.T @ (ground - np.array(place)))  # in the rectified view
                seen.append((flat.fx * p[0] / p[2] + flat.cx, flat.fy * p[1] / p[2] + flat.cy, p))
            assert abs(seen[0][1] - seen[1][1]) < 1e-6
            back = q @ np.array([seen[0][0], seen[0][1], seen[0][0] - seen[1][0], 1])
            assert np.allclose(back[:3] / back[3], seen[0][2], atol=1e-6)


def test_remapped_images(spark):
    values = random_raster(140, 90, 0.01)
    pixels = cells_of(spark, values)
    images = pixels.withColumn("frame_id", F.lit(0).cast("long")).unionByName(pixels.withColumns({"frame_id": F.lit(1).cast("long"), "v": F.col("v") + 100}))
    rng = random.Random(5)
    pair = [(4, 0, 1, struct_of((0, 0, 50), rotation(rng, 0.1)), struct_of((6, 1, 50), rotation(rng, 0.1)))]
    rect = imaging.rectification(spark.createDataFrame(pair, f"pair_id long, left_id long, right_id long, left {POSE}, right {POSE}"), LENS)
    got = found(imaging.remapped_pairs(B.to_blocks(images, ["v"], imaging.FRAME), ["v"], rect, LENS), ("v",), ("pair_id", "side", "frame_id"))
    r = rect.first()
    want = {}
    for side, turn in enumerate((r.left_turn, r.right_turn)):
        for x in range(140):
            for y in range(90):
                u, v = (float(z) for z in imaging.rectified_place(LENS, np.float64(x), np.float64(y), turn))
                value = None if math.isnan(u) else sample(values, u, v, "bilinear", imaging.frame_extent(LENS), "empty")
                if value is not None:
                    want[4, side, side, x, y] = value + 100 * side
    same(got, want)


def test_places_in_numpy_are_those_of_sql(spark):
    rows = [(48.0 + i / 7, 7.0 + i / 9) for i in range(20)]
    df = geo.with_steps(spark.createDataFrame(rows, "lat double, lon double"), geo.utm_forward("lat", "lon", "32")).collect()
    e, n = geo.utm_places(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 32)
    assert np.allclose(e, [r.easting for r in df], atol=1e-6) and np.allclose(n, [r.northing for r in df], atol=1e-6)
    back = geo.utm_positions(e, n, 32)
    assert np.allclose(back, np.array(rows).T, atol=1e-9)
    south = geo.utm_places(np.array([-33.0]), np.array([18.0]), 34, True)
    assert np.allclose(geo.utm_positions(*south, 34, True), [[-33.0], [18.0]], atol=1e-9)


@pytest.mark.parametrize("kernel", ["bilinear", "cubic"])
def test_warped_map(spark, kernel):
    res, zone = 10.0, 32
    values = {(x + 60000, y + 580000): v for (x, y), v in random_raster(90, 75, 0.15).items()}
    cells = cells_of(spark, values)
    source = B.extent_of(cells)
    blocks = B.to_blocks(cells, ["v"])
    out, target, step = imaging.warped(blocks, ["v"], source, res, zone, None, kernel)
    assert 14 < step < 18 and abs(target.width - 90) < 15 and abs(target.height - 75) < 15  # as many cells along the diagonal
    want = {}
    for x in range(target.x, target.x + target.width):
        for y in range(target.y, target.y + target.height):
            e, n = (float(z) / res for z in imaging.from_mercator(np.float64(x * step), np.float64(y * step), zone))
            value = sample(values, e, n, kernel, source, "empty", "skip")
            if value is not None:
                want[x, y] = value
    got = found(out)
    assert got.keys() == want.keys() and max(abs(got[k][0] - want[k]) for k in want) < 1e-4
    near = imaging.warped(blocks, ["v"], source, res, zone, None, kernel, tolerance=0.01)[0]
    near = found(near)
    assert len(near.keys() ^ got.keys()) < 0.02 * len(got) and np.mean([abs(near[k][0] - got[k][0]) for k in near.keys() & got.keys()]) < 0.2


def test_approximation_keeps_its_tolerance():
    calls = []

    def exact(x, y, _):
        calls.append(x.size)
        e, n = imaging.from_mercator(x * 20.0, y * 20.0, 32)
        return e / 10, n / 10

    y, x = np.divmod(np.arange(B.SIDE**2), B.SIDE)
    x, y = x + 50000.0, y + 340000.0
    for tolerance in (1e-2, 1e-4, 1e-12):
        calls.clear()
        u, v = imaging.approximated(exact, tolerance)(x, y, {})
        eu, ev = exact(x, y, {})
        assert np.abs(u - eu).max() <= tolerance and np.abs(v - ev).max() <= tolerance
        assert (B.SIDE**2 in calls[:-1]) == (tolerance < 1e-10)


@pytest.mark.parametrize("corner", [(60400, 579200, 20, 3000), (60400, 579200, 30, 40000), (49990, 999700, 40, 60), (50800, 998000, 5, 500)])
def test_warped_maps_visit_what_their_source_reaches(spark, corner):
    """Every node that falls on the source is in a block that is visited, beside and around the pole too; of a long map's extent most are not."""
    source, res, zone = B.Extent(*corner), 10.0, 32
    target, step = imaging.suggested_grid(source, res, zone, out_res=(3 if corner[0] == 60400 else 30) * res)
    got = {(r.tx, r.ty) for r in imaging.reached_blocks(spark, source, target, res, step, zone).collect()}
    rng = np.random.default_rng(5)
    u, v = source.x - 1 + rng.random(20_000) * (source.width + 1), source.y - 1 + rng.random(20_000) * (source.height + 1)
    mx, my = imaging.to_mercator(u * res, v * res, zone)
    for across, up in ((np.floor, np.floor), (np.ceil, np.ceil)):
        x, y = across(mx / step).astype(int), up(my / step).astype(int)
        bx, by = imaging.from_mercator(x * step, y * step, zone)
        inside = (bx / res > source.x - 1) & (bx / res < source.x + source.width) & (by / res > source.y - 1) & (by / res < source.y + source.height)
        inside &= (x >= target.x) & (x < target.x + target.width) & (y >= target.y) & (y < target.y + target.height)
        assert {(int(a), int(b)) for a, b in zip(x[inside] // B.SIDE, y[inside] // B.SIDE, strict=True)} <= got
    if corner[3] == 40000:
        assert len(got) < target.width * target.height / B.SIDE**2 / 3
