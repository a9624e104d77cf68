"""Images and maps seen another way: without their lens, as a rectified pair, on a web-Mercator lattice.

All of them give each target pixel a place in the source and gather it there, block by block (operators/blocks).
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.camera import Pinhole
from skylattice.operators import blocks as B

FRAME = ("frame_id",)


def frame_extent(camera: Pinhole) -> B.Extent:
    return B.Extent(0, 0, camera.width, camera.height)


def undistorted_images(images: DataFrame, layers: list[str], camera: Pinhole, kernel: str = "bilinear") -> DataFrame:
    """Blocks of images (frame_id) as an ideal lens would have them: every ideal pixel is looked up where the lens shows it.

    Pixels that the lens didn't show, or that lie beside an empty one, are empty."""

    def inverse(x, y, _):
        return camera.distorted(x, y)

    whole = frame_extent(camera)
    return B.resampled(images, layers, B.target_blocks(images.select(*FRAME).distinct(), whole), inverse, whole, whole, kernel, by=FRAME)


def _dot(a, b) -> Column:
    return sum((a[i] * b[i] for i in range(3)), F.lit(0.0))


def _cross(a, b) -> Column:
    return F.array(*[a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])


def _let(value: Column, body) -> Column:
    """The body with a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unit(a: Column) -> Column:
    return _let(a, lambda v: _let(F.sqrt(_dot(v, v)), lambda n: F.transform(v, lambda x: x / F.when(n > 1e-12, n))))


def rectification(pairs: DataFrame, camera: Pinhole) -> DataFrame:
    """pairs with left_turn and right_turn (rotations from the rectified view into each camera, row after row), baseline and q (from column,
    row and disparity to a place in the rectified view, row after row).

    pairs: left and right, structs of a position x, y, z and the camera-to-world rotation r00 .. r22. The rectified view looks along the
    mean of both axes, made square to the baseline, which becomes its x axis. Pairs without a baseline square to their view have none."""
    place = lambda s: [F.col(f"{s}.{c}") for c in "xyz"]
    turn = lambda s: [[F.col(f"{s}.r{i}{j}") for j in range(3)] for i in range(3)]
    view = F.array(*[turn("left")[i][2] + turn("right")[i][2] for i in range(3)])
    way = F.array(*[b - a for a, b in zip(place("left"), place("right"), strict=True)])
    axes = _let(_unit(way), lambda e1: _let(_unit(_cross(view, e1)), lambda e2: F.array(e1, e2, _cross(e1, e2))))
    out = pairs.withColumns({"rect_axes": axes, "baseline": F.sqrt(_dot(way, way))}).where(~F.exists("rect_axes", lambda e: F.exists(e, lambda x: x.isNull())))
    into = lambda s: F.array(*[_dot([turn(s)[k][i] for k in range(3)], F.col("rect_axes")[j]) for i in range(3) for j in range(3)])
    zero, one, base = F.lit(0.0), F.lit(1.0), F.col("baseline")
    q = F.array(one, zero, zero, F.lit(-camera.cx), zero, one, zero, F.lit(-camera.cy), zero, zero, zero, F.lit(camera.fx), zero, zero, one / F.when(base > 0, base), zero)
    return out.withColumns({"left_turn": into("left"), "right_turn": into("right"), "q": q}).drop("rect_axes")


def rectified_camera(camera: Pinhole) -> Pinhole:
    """The camera of both rectified images: one focal length, no lens."""
    return replace(camera, fy=camera.fx, k1=0.0, k2=0.0, p1=0.0, p2=0.0, k3=0.0)


def rectified_place(camera: Pinhole, x, y, turn):
    """Where a pixel of the rectified image lies in a camera's image; NaN behind the camera."""
    flat = rectified_camera(camera)
    ray = ((x - flat.cx) / flat.fx, (y - flat.cy) / flat.fy, 1.0)
    px, py, pz = (turn[3 * i] * ray[0] + turn[3 * i + 1] * ray[1] + turn[3 * i + 2] for i in range(3))
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where(pz > 1e-9, pz, np.nan)
        return camera.distorted(camera.fx * px / z + camera.cx, camera.fy * py / z + camera.cy)


def remapped_pairs(images: DataFrame, layers: list[str], rectified: DataFrame, camera: Pinhole, kernel: str = "bilinear") -> DataFrame:
    """Blocks of both images of every pair as the rectified view has them: pair_id, side (0 left, 1 right), frame_id, tx, ty, layers.

    rectified: pair_id, left_id, right_id and the turns of rectification(). Places of the ground lie in one row of both."""
    side = lambda n, s: rectified.select("pair_id", F.lit(n).alias("side"), F.col(f"{s}_id").alias("frame_id"), F.col(f"{s}_turn").alias("turn"))
    whole = frame_extent(camera)

    def inverse(x, y, row):
        return rectified_place(camera, x, y, row["turn"])

    targets = B.target_blocks(side(0, "left").unionByName(side(1, "right")), whole)
    return B.resampled(images, layers, targets, inverse, whole, whole, kernel, by=FRAME, keep=("pair_id", "side", "turn")).drop("turn")


# ---------------------------------------------------------------- warping of maps


def approximated(inverse: B.Inverse, tolerance: float) -> B.Inverse:
    """The map by a biquadratic through nine places of a block, where that is right within a tolerance (in cells) at places between them; else itself."""
    nodes = np.array([0.0, (B.SIDE - 1) / 2, B.SIDE - 1])
    probes = np.array([(B.SIDE - 1) / 5, (B.SIDE - 1) * 0.7, (B.SIDE - 1) * 0.95])

    def weights(at):
        return np.stack([np.prod([(at - b) / (a - b) for b in nodes if b != a], axis=0) for a in nodes], -1)

    def fast(x, y, row):
        if x.size != B.SIDE * B.SIDE:
            return inverse(x, y, row)
        x0, y0 = x[0], y[0]
        gx, gy = (g.ravel() for g in np.meshgrid(x0 + nodes, y0 + nodes))
        u, v = (z.reshape(3, 3) for z in inverse(gx, gy, row))
        px, py = (g.ravel() for g in np.meshgrid(probes, probes))
        wx, wy = weights(px), weights(py)
        guess = [np.einsum("pi,pj,ij->p", wy, wx, z) for z in (u, v)]
        exact = inverse(px + x0, py + y0, row)
        off = max(float(np.max(np.abs(a - b))) for a, b in zip(guess, exact, strict=True))
        if not off <= tolerance / 4:  # the probes are near where it is worst, not at it
            return inverse(x, y, row)
        w = weights(np.arange(float(B.SIDE)))
        return tuple((w @ z @ w.T).ravel() for z in (u, v))

    return fast


def to_mercator(easting, northing, zone: int, south: bool = False):
    """Web-Mercator metres of UTM places."""
    lat, lon = geo.utm_positions(easting, northing, zone, south)
    return np.radians(lon) * geo.AXIS, geo.AXIS * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))


def from_mercator(mx, my, zone: int, south: bool = False):
    """UTM places of web-Mercator metres."""
    return geo.utm_places(np.degrees(2 * np.arctan(np.exp(my / geo.AXIS)) - math.pi / 2), np.degrees(mx / geo.AXIS), zone, south)


#: Places a side of a map's outline that decide where its warped form lies.
OUTLINE = 21


def suggested_grid(source: B.Extent, res: float, zone: int, south: bool = False, out_res: float | None = None) -> tuple[B.Extent, float]:
    """Extent and resolution of a UTM raster on the web-Mercator lattice: as many cells along its diagonal as it had, around its outline."""
    along = np.linspace(0, 1, OUTLINE)
    left, low, right, top = source.x, source.y, source.x + source.width - 1, source.y + source.height - 1
    side = np.concatenate
    xs = side([left + (right - left) * along] * 2 + [np.full(OUTLINE, left), np.full(OUTLINE, right)])
    ys = side([np.full(OUTLINE, low), np.full(OUTLINE, top)] + [low + (top - low) * along] * 2)
    mx, my = to_mercator(xs * res, ys * res, zone, south)
    if out_res is None:
        cells = math.hypot(right - left, top - low)
        ax, ay = to_mercator(np.array([left, right]) * res, np.array([low, top]) * res, zone, south)
        out_res = float(math.hypot(ax[1] - ax[0], ay[1] - ay[0]) / cells) if cells else res
    x, y = math.floor(mx.min() / out_res), math.floor(my.min() / out_res)
    return B.Extent(x, y, math.ceil(mx.max() / out_res) - x + 1, math.ceil(my.max() / out_res) - y + 1), out_res


def _seen_from(tx: int, ty: int, source: B.Extent, target: B.Extent, res: float, out_res: float, zone: int, south: bool) -> tuple[int, int, int, int] | None:
    """Target blocks (first and last column, first and last row) that hold all nodes within a cell of a source block's cells."""
    left, right = max(tx * B.SIDE, source.x) - 1, min(tx * B.SIDE + B.SIDE, source.x + source.width)
    low, top = max(ty * B.SIDE, source.y) - 1, min(ty * B.SIDE + B.SIDE, source.y + source.height)
    xs, ys = np.arange(left, right + 1.0), np.arange(low, top + 1.0)
    # the outline of an area is the outline of its image, but for one around the pole
    ex = np.concatenate([xs, xs, np.full(len(ys), left), np.full(len(ys), right)]) * res
    ny = np.concatenate([np.full(len(xs), low), np.full(len(xs), top), ys, ys]) * res
    with np.errstate(all="ignore"):
        mx, my = to_mercator(ex, ny, zone, south)
    pole = geo.SCALE * geo._RADIUS * math.pi / 2
    over = (geo.FALSE_NORTHING - pole if south else pole), (pole if not south else geo.FALSE_NORTHING + pole)
    around = left * res <= geo.FALSE_EASTING <= right * res and any(low * res <= n <= top * res for n in over)
    x0, y0, x1, y1 = target.x, target.y, target.x + target.width - 1, target.y + target.height - 1
    if not around and np.isfinite(mx).all() and np.isfinite(my).all():
        far = 2 * out_res + max(float(np.abs(np.diff(z)).max()) for part in (slice(0, len(xs)), slice(2 * len(xs), 2 * len(xs) + len(ys))) for z in (mx[part], my[part]))  # what the outline may bulge between two places
        x0, x1 = max(x0, math.floor((mx.min() - far) / out_res)), min(x1, math.ceil((mx.max() + far) / out_res))
        y0, y1 = max(y0, math.floor((my.min() - far) / out_res)), min(y1, math.ceil((my.max() + far) / out_res))
    return None if x0 > x1 or y0 > y1 else (x0 // B.SIDE, x1 // B.SIDE, y0 // B.SIDE, y1 // B.SIDE)


def reached_blocks(spark, source: B.Extent, target: B.Extent, res: float, out_res: float, zone: int, south: bool = False) -> DataFrame:
    """The blocks (tx, ty) of a warped map that its source may reach: found from the source's blocks, as a long map is a thin line through its target's extent."""

    def run(batches):
        for b in batches:
            got = [_seen_from(r["tx"], r["ty"], source, target, res, out_res, zone, south) for r in b.to_pylist()]
            cols = list(zip(*[g for g in got if g], strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["x0", "x1", "y0", "y1"])

    seen = B.target_blocks(spark.range(1).select(), source).repartition("tx", "ty").mapInArrow(run, "x0 long, x1 long, y0 long, y1 long")
    wide = seen.select(F.explode(F.sequence("x0", "x1")).alias("tx"), "y0", "y1")
    return wide.select("tx", F.explode(F.sequence("y0", "y1")).alias("ty")).distinct()


def warped(blocks: DataFrame, layers: list[str], source: B.Extent, res: float, zone: int, out_res: float | None = None, kernel: str = "bilinear", south: bool = False, tolerance: float = 0.0) -> tuple[DataFrame, B.Extent, float]:
    """A UTM raster (cells at gx * res, gy * res) on the web-Mercator lattice, with the lattice's extent and resolution.

    A node is empty if the cell nearest to it is; else it takes the taps that have a value. With a tolerance, places are approximated within a block to so many cells."""
    target, out_res = suggested_grid(source, res, zone, south, out_res)
    step = out_res

    def inverse(x, y, _):
        easting, northing = from_mercator(x * step, y * step, zone, south)
        return easting / res, northing / res

    targets = reached_blocks(blocks.sparkSession, source, target, res, out_res, zone, south)
    out = B.resampled(blocks, layers, targets, approximated(inverse, tolerance) if tolerance else inverse, source, target, kernel, "empty", "skip")
    return out, target, out_res
