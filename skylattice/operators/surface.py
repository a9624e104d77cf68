"""Surface models of frames: planar where nothing is known, interpolated elevation where there are points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.operators import spatial
from skylattice.operators.depth import lower_median

PLANAR, ELEVATION = "PLANAR", "ELEVATION"
#: How normals are made: means of the points' own, the plane through three neighbours, or the best plane of all.
MODES = ("prior", "nearest", "furthest", "best")


def planar(boxes: DataFrame, res: float, *keep: str) -> DataFrame:
    """gx, gy and elevation of every lattice node in rectangles (x, y, width, height, elevation), and the columns to keep."""
    first, last = (lambda c: F.ceil(F.col(c) / res)), (lambda c, n: F.floor((F.col(c) + F.col(n)) / res))
    span = lambda c, n: F.explode(F.when(first(c) <= last(c, n), F.sequence(first(c), last(c, n))))
    return boxes.withColumn("gx", span("x", "width")).withColumn("gy", span("y", "height")).select(*keep, "gx", "gy", F.col("elevation").cast("double").alias("elevation"))


def node_normals(points: DataFrame, rings: DataFrame, res: float, rounds: int, window: tuple[int, int, int, int], mode: str, by: tuple[str, ...] = ()) -> DataFrame:
    """gx, gy, nx, ny, nz of nodes from the points of their rings (gx, gy, ring of idw_surface); upward unit vectors."""
    key = [*by, "gx", "gy"]
    near = spatial.near_nodes(points, res, math.sqrt((rounds - 1) * res), *window).withColumn("own", F.floor(F.col("d2") / res) + 1)
    used = near.join(rings.select(*key, "ring"), key).where(F.col("own") <= F.col("ring"))
    if mode == "best":
        return spatial.fit_planes(spatial.plane_moments(used, *key)).select(*key, "nx", "ny", "nz")
    d = F.col("d2").desc() if mode == "furthest" else F.col("d2")
    nth = F.row_number().over(W.partitionBy(*key).orderBy(d, "x", "y", "z"))
    three = used.withColumn("nth", nth).where("nth <= 3").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "x", "y", "z"))).alias("p"))
    corner = lambda k: tuple(F.col("p")[k][c] for c in ("x", "y", "z"))
    return three.select(*key, *[n.alias(c) for n, c in zip(spatial.plane_of_three(corner(0), corner(1), corner(2)), ("nx", "ny", "nz"), strict=True)])


def elevation_surface(points: DataFrame, res: float | None, window: tuple[int, int, int, int], rounds: int = 5, mode: str | None = None, by: tuple[str, ...] = (), blur: bool = True) -> DataFrame:
    """gx, gy and elevation of the nodes of a window from points (x, y, z), and nx, ny, nz by a mode.

    Without res it is the ground sampling distance of the points. Normals of three neighbours are noisy: they are
    smoothed by the median of 5 x 5 nodes, a component at a time, unless blur says otherwise."""
    if mode is not None and mode not in MODES:
        raise ValueError(f"normals are made by one of {MODES}")
    if res is None:
        res = spatial.ground_sampling_distance(points, 100).first()["gsd"]
        if res is None:
            raise ValueError("too few points for a ground sampling distance")
    values = ("z", "nx", "ny", "nz") if mode == "prior" else ("z",)
    surface = spatial.idw_surface(points, res, rounds, window, values, by, rings=True)
    key = [*by, "gx", "gy"]
    if mode == "prior":
        surface = spatial.normalised(surface, "nx", "ny", "nz")
    elif mode is not None:
        normals = node_normals(points, surface, res, rounds, window, mode, by)
        if blur and mode != "best":
            for c in ("nx", "ny", "nz"):
                normals = spatial.smooth(normals, c, by=by)
        surface = surface.join(normals, key, "left")
    return surface.drop("ring").withColumnRenamed("z", "elevation")


def assumptions(frames: DataFrame, dense: DataFrame, try_elevation: bool = True) -> DataFrame:
    """frames with assumption: ELEVATION for keyframes with a pose and a dense cloud (frame_id in dense), else PLANAR."""
    there = dense.select("frame_id").distinct().withColumn("is_dense", F.lit(True))
    good = (F.col("is_keyframe") == 1) & (F.col("has_pose") == 1) & F.coalesce("is_dense", F.lit(False)) & F.lit(try_elevation)
    return frames.join(there, "frame_id", "left").withColumn("assumption", F.when(good, ELEVATION).otherwise(PLANAR)).drop("is_dense")


def plane_offsets(sparse: DataFrame) -> DataFrame:
    """frame_id and offset: the lower median height of a frame's sparse points."""
    return lower_median(sparse, "z", "frame_id").withColumnRenamed("median", "offset")


def frame_surfaces(frames: DataFrame, dense: DataFrame, sparse: DataFrame, res: float, window: tuple[int, int, int, int], rounds: int = 5, try_elevation: bool = True) -> DataFrame:
    """frame_id, gx, gy, elevation and assumption of every frame's surface; frames hold their ground rectangle (x, y, width, height).

    A planar surface lies at the frame's plane offset, or at 0 where it has no sparse points."""
    known = assumptions(frames, dense, try_elevation)
    flat = known.where(F.col("assumption") == PLANAR).join(plane_offsets(sparse), "frame_id", "left").withColumn("elevation", F.coalesce("offset", F.lit(0.0)))
    raised = known.where(F.col("assumption") == ELEVATION)
    cloud = dense.join(raised.select("frame_id"), "frame_id", "left_semi")
    cells = elevation_surface(cloud, res, window, rounds, by=("frame_id",))
    rect = raised.select("frame_id", *[F.ceil(F.col(c) / res).alias(f"{c}0") for c in ("x", "y")], *[F.floor((F.col(c) + F.col(n)) / res).alias(f"{c}1") for c, n in (("x", "width"), ("y", "height"))])
    inside = cells.join(rect, "frame_id").where(F.col("gx").between(F.col("x0"), F.col("x1")) & F.col("gy").between(F.col("y0"), F.col("y1")))
    columns = ("frame_id", "gx", "gy", "elevation")
    return planar(flat, res, "frame_id").select(*columns, F.lit(PLANAR).alias("assumption")).unionByName(inside.select(*columns, F.lit(ELEVATION).alias("assumption")))
