"""Depth maps as pixel rows (frame_id, r, c, depth); NULL where there is no depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.camera import Pinhole, heading_rotation, to_world
from skylattice.operators import selection

VALID = "depth > 0"
EYE = ("easting", "northing", "altitude")


def stats(depth: DataFrame) -> DataFrame:
    """n, min, max over valid depths, and the upper median over all pixels with missing ones as -1."""
    filled = depth.withColumn("all_depth", F.coalesce("depth", F.lit(-1.0)))
    spans = filled.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.expr(VALID), F.col("depth"))).alias("min_depth"), F.max(F.when(F.expr(VALID), F.col("depth"))).alias("max_depth"),
    )
    return selection.with_group(spans, selection.upper_median(filled, "all_depth", ("frame_id",), "median_depth"), ("frame_id",))


def lower_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The lower median of the values that are there."""
    return selection.lower_median(df, value, by)


def clamp(depth: DataFrame, low: float = 0.25, high: float = 1.75) -> DataFrame:
    """Depths outside low..high times the frame's lower median of valid depths become NULL."""
    mid = lower_median(depth.where(VALID), "depth", "frame_id")
    inside = F.col("depth").between(low * F.col("median"), high * F.col("median"))
    return depth.join(mid, "frame_id", "left").select("frame_id", "r", "c", F.when(inside, F.col("depth")).alias("depth"))


def reproject(depth: DataFrame, camera: Pinhole) -> DataFrame:
    """Points in the camera's frame of every valid pixel."""
    x, y, z = camera.ray(F.col("c"), F.col("r"), F.col("depth"))
    return depth.where(VALID).select("frame_id", "r", "c", x.alias("x"), y.alias("y"), z.alias("z"))


def from_points(points: DataFrame, camera: Pinhole, order: str = "point_id") -> DataFrame:
    """Depth of every pixel that points (x, y, z in the camera's frame) fall on; the last point wins."""
    u, v = camera.to_image(F.col("x"), F.col("y"), F.col("z"))
    on = points.select(F.floor(u).cast("int").alias("c"), F.floor(v).cast("int").alias("r"), "z", order)
    return on.where(F.col("c").between(0, camera.width - 1) & F.col("r").between(0, camera.height - 1)).groupBy("r", "c").agg(F.max_by("z", order).alias("depth"))


def normals(depth: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Unit normals by central differences, where all four neighbours have a depth.

    With the shape (rows, columns) of the maps, pixels on the border have the normals of those next to them inside."""
    across, down = W.partitionBy("frame_id", "r").orderBy("c"), W.partitionBy("frame_id", "c").orderBy("r")
    there = depth.where(F.col("depth").isNotNull())
    near = lambda f, w, at, step: F.when(f(at).over(w) == F.col(at) + step, f("depth").over(w))
    got = there.withColumns({"west": near(F.lag, across, "c", -1), "east": near(F.lead, across, "c", 1)})
    got = got.withColumns({"north": near(F.lag, down, "r", -1), "south": near(F.lead, down, "r", 1)}).dropna(subset=["west", "east", "north", "south"])
    dx, dy = (F.col("east") - F.col("west")) / 2, (F.col("south") - F.col("north")) / 2
    length = F.sqrt(dx * dx + dy * dy + 1)
    inner = got.select("frame_id", "r", "c", (-dx / length).alias("nx"), (-dy / length).alias("ny"), (1 / length).alias("nz"))
    if shape is None:
        return inner

    def reflected(c: str, n: int):
        own = F.col(c)
        return F.explode(F.array_compact(F.array(own, F.when(own == 1, own - 1), F.when(own == n - 2, own + 1))))

    return inner.withColumn("r", reflected("r", shape[0])).withColumn("c", reflected("c", shape[1]))


def votes(depth: DataFrame, tolerance: float = 0.1, before: int = 2, after: int = 1, least: int = 2) -> DataFrame:
    """n_votes of every valid pixel: neighbouring frames whose depth differs by less than a share; kept with enough of them."""
    a = depth.where(VALID).select("frame_id", "r", "c", "depth")
    reach = F.transform(F.sequence(F.lit(-before), F.lit(after)), lambda k: F.col("frame_id") - k)
    b = a.select(F.explode(F.filter(reach, lambda f: f != F.col("frame_id"))).alias("frame_id"), "r", "c", F.col("depth").alias("other"))
    agree = F.abs(F.col("other") - F.col("depth")) / F.col("depth") < tolerance
    joined = a.join(b, ["frame_id", "r", "c"], "left").groupBy("frame_id", "r", "c", "depth").agg(F.sum(F.when(agree, 1).otherwise(0)).alias("n_votes"))
    return joined.select("frame_id", "r", "c", "depth", F.col("n_votes").cast("long").alias("n_votes"), (F.col("n_votes") >= least).alias("kept"))


def coverage(voted: DataFrame, least: float = 30.0) -> DataFrame:
    """Percent of pixels kept per frame, and whether the depth map stays."""
    share = 100 * F.avg(F.col("kept").cast("int"))
    return voted.groupBy("frame_id").agg(share.alias("coverage"), (share >= least).alias("stays"))


def consistent(depth: DataFrame, **how) -> DataFrame:
    """Depth maps with inconsistent pixels removed; those with too little coverage go."""
    voted = votes(depth, **how)
    stays = coverage(voted).where("stays").select("frame_id")
    return voted.join(stays, "frame_id", "left_semi").select("frame_id", "r", "c", F.when(F.col("kept"), F.col("depth")).alias("depth"))


def scene_depth(points: DataFrame, r2: tuple[float, float, float], tz: float, *by: str, most: int | None = None, order: str = "point_id") -> DataFrame:
    """min, lower median and max of the points' depth in a camera: third row of its rotation, and translation; of the first most points by order, if given."""
    if most is not None:
        nth = F.row_number().over(W.partitionBy(*by).orderBy(order))
        points = points.withColumn("nth", nth).where(F.col("nth") <= most)
    d = points.withColumn("d", r2[0] * F.col("x") + r2[1] * F.col("y") + r2[2] * F.col("z") + tz)
    spans = d.groupBy(*by).agg(F.min("d").alias("min_depth"), F.max("d").alias("max_depth"))
    return selection.with_group(spans, selection.lower_median(d, "d", by, "median_depth"), by).select(*by, "min_depth", "median_depth", "max_depth")


def placed(depth: DataFrame, frames: DataFrame, camera: Pinhole) -> DataFrame:
    """frame_id, r, c, x, y, z: world points of valid pixels; frames hold the pose (easting, northing, altitude, heading)."""
    posed = reproject(depth, camera).join(frames.select("frame_id", *EYE, "heading"), "frame_id")
    at = to_world(heading_rotation(F.col("heading")), tuple(F.col(c) for c in EYE), tuple(F.col(c) for c in ("x", "y", "z")))
    return posed.select("frame_id", "r", "c", *[v.alias(c) for v, c in zip(at, ("x", "y", "z"), strict=True)])


def dense_points(depth: DataFrame, frames: DataFrame, camera: Pinhole, low: float = 0.25, high: float = 1.75, **how) -> DataFrame:
    """frame_id, r, c, x, y, z and nx, ny, nz: world points and normals of depth maps that are clamped to a range about their median and
    checked against their neighbours."""
    clamped = clamp(depth, low, high)
    local = normals(clamped, (camera.height, camera.width)).join(frames.select("frame_id", "heading"), "frame_id")
    up = to_world(heading_rotation(F.col("heading")), (F.lit(0.0),) * 3, tuple(-F.col(c) for c in ("nx", "ny", "nz")))
    up = local.select("frame_id", "r", "c", *[v.alias(c) for v, c in zip(up, ("nx", "ny", "nz"), strict=True)])
    return placed(consistent(clamped, **how), frames, camera).join(up, ["frame_id", "r", "c"], "left")
