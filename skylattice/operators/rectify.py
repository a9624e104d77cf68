"""Rectification: which pixel of which frame shows each lattice cell of a surface, and the orthophoto made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import camera as C

_EYE = ("easting", "northing", "altitude")


def footprints(frames: DataFrame, camera: C.Pinhole, ground: float = 0.0, distorted: bool = False) -> DataFrame:
    """frames with x, y, width, height: the bounding box of their image on the plane at a height; distorted takes the corners that the lens shows."""
    r, t = C.heading_rotation(F.col("heading")), tuple(F.col(c) for c in _EYE)
    hits = [C.plane_hit(r, t, camera, u, v, F.lit(ground)) for u, v in (camera.undistorted_corners() if distorted else camera.corners())]
    xs, ys = zip(*hits, strict=True)
    low = lambda c: reduce(lambda a, b: F.least(a, b), c)
    high = lambda c: reduce(lambda a, b: F.greatest(a, b), c)
    return frames.select("*", low(xs).alias("x"), low(ys).alias("y"), (high(xs) - low(xs)).alias("width"), (high(ys) - low(ys)).alias("height"))


def rectify(frames: DataFrame, camera: C.Pinhole, res: float, height: float) -> DataFrame:
    """frame_id, gx, gy, px, py and viewing angle of every cell of a flat surface that a frame shows.

    A frame makes only the cells of its own footprint, so rows grow with the covered ground."""
    boxes = footprints(frames, camera)
    span = lambda c, n: F.sequence(F.ceil(F.col(c) / res), F.floor((F.col(c) + F.col(n)) / res))
    there = lambda c, n: F.ceil(F.col(c) / res) <= F.floor((F.col(c) + F.col(n)) / res)
    cells = boxes.where(there("x", "width") & there("y", "height")).withColumn("gx", F.explode(span("x", "width"))).withColumn("gy", F.explode(span("y", "height")))
    return _shown(cells, camera, (F.col("gx") * res, F.col("gy") * res, F.lit(height)))


def rectify_surface(frames: DataFrame, surface: DataFrame, camera: C.Pinhole, res: float, ground: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for a surface of cells (gx, gy, elevation); cells without elevation show nothing, and none lies below ground. keep names further columns of frames.

    A frame meets the blocks of cells under its footprint on the ground, so rows grow with what frames see."""
    boxes = footprints(frames, camera, ground)
    block = 32
    span = lambda c, n: F.sequence(F.floor(F.col(c) / res / block), F.floor((F.col(c) + F.col(n)) / res / block))
    spread = boxes.withColumn("bx", F.explode(span("x", "width"))).withColumn("by", F.explode(span("y", "height")))
    cells = surface.where(F.col("elevation").isNotNull()).select("gx", "gy", "elevation", F.floor(F.col("gx") / block).alias("bx"), F.floor(F.col("gy") / block).alias("by"))
    return _shown(cells.join(spread, ["bx", "by"]), camera, (F.col("gx") * res, F.col("gy") * res, F.col("elevation")), ["elevation", *keep] if keep else None)


def rectify_frames(frames: DataFrame, surfaces: DataFrame, camera: C.Pinhole, res: float) -> DataFrame:
    """The same for surfaces of single frames (frame_id, gx, gy, elevation and further columns, which are kept)."""
    ground = surfaces.where(F.col("elevation").isNotNull())
    rest = [c for c in ground.columns if c not in ("frame_id", "gx", "gy")]
    return _shown(frames.join(ground, "frame_id"), camera, (F.col("gx") * res, F.col("gy") * res, F.col("elevation")), rest)


def colored(rectified: DataFrame, images: DataFrame) -> DataFrame:
    """Rectified cells with the color of their pixel (images: frame_id, r, c, color)."""
    pixels = images.select("frame_id", F.col("r").cast("int").alias("py"), F.col("c").cast("int").alias("px"), "color")
    return rectified.join(pixels, ["frame_id", "px", "py"], "left")


def orthophotos(frames: DataFrame, surfaces: DataFrame, images: DataFrame, camera: C.Pinhole, res: float) -> DataFrame:
    """frame_id, gx, gy, color, elevation, angle, elevated and n_obs of every cell of every frame's surface that its image shows.

    elevated is 0 on surfaces of ELEVATION and 255 on planar ones. Its rows, with a seq, are what a mosaic blends."""
    return _photographed(rectify_frames(frames, surfaces, camera, res), images)


def orthophotos_of_map(frames: DataFrame, surface: DataFrame, images: DataFrame, camera: C.Pinhole, res: float, ground: float = 0.0) -> DataFrame:
    """The same of frames (with the assumption of each) over one surface that all of them see, none of whose cells lies below ground."""
    return _photographed(rectify_surface(frames, surface, camera, res, ground, ("assumption",)), images)


def _photographed(cells: DataFrame, images: DataFrame) -> DataFrame:
    flag = F.when(F.col("assumption") == "ELEVATION", 0).otherwise(255)
    return colored(cells, images).select("frame_id", "gx", "gy", "color", "elevation", "angle", flag.alias("elevated"), F.lit(1).alias("n_obs"))


def _shown(cells: DataFrame, camera: C.Pinhole, p: tuple, keep: list[str] | None = None) -> DataFrame:
    r, t = C.heading_rotation(F.col("heading")), tuple(F.col(c) for c in _EYE)
    u, v = camera.to_image(*C.to_camera(r, t, p))
    seen = cells.withColumns({"u": u, "v": v, "angle": C.elevation_angle(t, p)})
    inside = (F.col("u") > 0) & (F.col("u") < camera.width) & (F.col("v") > 0) & (F.col("v") < camera.height)
    return seen.where(inside).select("frame_id", "gx", "gy", F.floor("u").cast("int").alias("px"), F.floor("v").cast("int").alias("py"), "angle", *(keep or []))


def visible_cells(frames: DataFrame, camera: C.Pinhole, res: float, height: float) -> DataFrame:
    """gx, gy, number of frames that show each cell and the best angle."""
    return rectify(frames, camera, res, height).groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("best_angle"))
