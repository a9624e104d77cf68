"""Georeferencing: scales between GNSS and visual positions, similarity fits, errors and drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.camera import distance
from skylattice.operators.folds import folded
from skylattice.operators.tables import written

GIS, VIS = ("gx", "gy", "gz"), ("vx", "vy", "vz")
#: Metres that two GNSS positions must be apart to give a scale (fixed value).
MIN_GIS = 10.0


def two_point_scale(a, b, least_visual: float) -> Column:
    """Ratio of the GNSS to the visual distance of two measurements, or -1; a and b give a column by name."""
    gis = distance(tuple(a(c) for c in GIS), tuple(b(c) for c in GIS))
    vis = distance(tuple(a(c) for c in VIS), tuple(b(c) for c in VIS))
    return F.when((gis > MIN_GIS) & (vis > least_visual), gis / F.when(vis > 0, vis)).otherwise(-1.0)


def scales(poses: DataFrame, least_visual: float) -> DataFrame:
    """Scale of each measurement against the one before it of its camera."""
    w = W.partitionBy("camera_id").orderBy("seq")
    s = two_point_scale(F.col, lambda c: F.lag(c).over(w), least_visual)
    return poses.withColumn("scale", F.when(F.lag("seq").over(w).isNotNull(), s)).where(F.col("scale").isNotNull())


def scale_drift(poses: DataFrame, scale: float, least_visual: float, samples: int = 3) -> DataFrame:
    """Percent by which the newest measurement's mean scale against earlier ones, sampled evenly, differs from scale; -1 with fewer than two."""
    size = poses.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct(*GIS, *VIS), "seq").alias("last"))
    stride = F.greatest(F.lit(1), F.floor((F.col("n") - 1) / samples))
    ranked = poses.withColumn("nth", F.row_number().over(W.partitionBy("camera_id").orderBy("seq")) - 1)
    picked = ranked.join(size, "camera_id").where((F.col("nth") % stride == 0) & (F.col("nth") < F.col("n") - 1))
    s = two_point_scale(F.col, lambda c: F.col("last")[c], least_visual)
    good = F.when(s > 0, s)
    drift = F.when(F.count(good) >= 2, F.abs(1 - F.avg(good) / scale) * 100).otherwise(-1.0)
    return picked.groupBy("camera_id").agg(drift.alias("drift"))


def apply_transform(df: DataFrame, t: list[list[float]], cols=("x", "y", "z")) -> DataFrame:
    """Homogeneous 4 x 4 transform of three columns."""
    p = [F.col(c) for c in cols]
    row = lambda i: sum((t[i][j] * p[j] for j in range(3)), F.lit(0.0)) + t[i][3]
    w = row(3)
    return df.withColumns({c: row(i) / w for i, c in enumerate(cols)})


def reference_error(poses: DataFrame, t: list[list[float]]) -> DataFrame:
    """Mean distance of transformed visual positions to GNSS positions, a row a camera."""
    moved = apply_transform(poses, t, VIS)
    d = distance(tuple(F.col(c) for c in VIS), tuple(F.col(c) for c in GIS))
    return moved.groupBy("camera_id").agg(F.avg(d).alias("error"), F.count(F.lit(1)).alias("n"))


def umeyama(poses: DataFrame) -> DataFrame:
    """Similarity fit (scale, rotation r00..r22, translation tx, ty, tz) from visual to GNSS positions, a row a camera.

    Spark sums means and covariances; the decomposition of each 3 x 3 matrix is a small numpy step on one row."""
    cov = [F.covar_pop(g, v).alias(f"c_{g}_{v}") for g in GIS for v in VIS]
    means = [F.avg(c).alias(f"m_{c}") for c in (*GIS, *VIS)]
    spread = (F.var_pop("vx") + F.var_pop("vy") + F.var_pop("vz")).alias("spread")
    moments = poses.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), spread, *means, *cov)
    names = ["scale", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                c = np.array([[row[f"c_{g}_{v}"] for v in VIS] for g in GIS])
                u, d, vt = np.linalg.svd(c)
                s = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
                r = u @ s @ vt
                scale = float(np.trace(np.diag(d) @ s) / row["spread"]) if row["spread"] > 0 else 1.0
                t = np.array([row[f"m_{g}"] for g in GIS]) - scale * r @ np.array([row[f"m_{v}"] for v in VIS])
                out.append([row["camera_id"], row["n"], scale, *r.ravel().tolist(), *t.tolist()])
            yield pd.DataFrame(out, columns=["camera_id", "n", *names])

    kind = moments.schema["camera_id"].dataType.simpleString()
    return moments.mapInPandas(solve, f"camera_id {kind}, n long, " + ", ".join(f"{n} double" for n in names))


def judged_unique(poses: DataFrame, least_visual: float) -> DataFrame:
    """camera_id, seq, whether a measurement gives a positive scale against every one chosen before it, and the sum and number of the scales met
    on the way (newest first, up to the first that is none).

    The choice depends on itself; a task folds its cameras' tracks in order and holds the measurements chosen so far."""

    def start():
        chosen = [np.empty((64, 6)), 0]

        def step(row):
            held, n = chosen
            at = np.array(row[2:8], float)
            apart = (held[:n] - at) ** 2
            gis, vis = np.sqrt(apart[:, :3].sum(1))[::-1], np.sqrt(apart[:, 3:].sum(1))[::-1]
            good = (gis > MIN_GIS) & (vis > least_visual)
            met = int(n if good.all() else good.argmin())
            if met == n:
                if n == len(held):
                    held = chosen[0] = np.concatenate([held, np.empty_like(held)])
                held[n] = at
                chosen[1] = n + 1
            return row[0], row[1], met == n, float((gis[:met] / vis[:met]).sum()), met

        return step

    return folded(poses.select("camera_id", "seq", *GIS, *VIS), "camera_id", ["seq"], start, "camera_id long, seq long, chosen boolean, total double, n long")


def greedy_unique(poses: DataFrame, least_visual: float) -> DataFrame:
    """camera_id and seq of the measurements that judged_unique chooses."""
    return judged_unique(poses, least_visual).where("chosen").select("camera_id", "seq")


#: Rotation columns of a measurement's GNSS pose and visual pose; a transform is an array of 16 values, row by row.
GROT, VROT = tuple(f"g{i}{j}" for i in range(3) for j in range(3)), tuple(f"v{i}{j}" for i in range(3) for j in range(3))


def _times(t, rot: list[Column], p: list[Column]) -> tuple[list[list[Column]], list[Column]]:
    """T * (rot | p) with the columns of the rotation at length 1; t(i, j) gives the transform."""
    r = [[sum((t(i, k) * rot[3 * k + j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    length = [F.sqrt(sum((r[i][j] * r[i][j] for i in range(3)), F.lit(0.0))) for j in range(3)]
    at = [sum((t(i, k) * p[k] for k in range(3)), F.lit(0.0)) + t(i, 3) for i in range(3)]
    return [[r[i][j] / length[j] for j in range(3)] for i in range(3)], at


def georeferenced(poses: DataFrame, transforms: DataFrame) -> DataFrame:
    """poses (v00..v22, vx, vy, vz) with their geographic pose: g00..g22 and gx, gy, gz of T * pose, without scale; transforms: camera_id, t."""
    r, at = _times(lambda i, j: F.col("t")[4 * i + j], [F.col(c) for c in VROT], [F.col(c) for c in VIS])
    new = {f"g{i}{j}": r[i][j] for i in range(3) for j in range(3)} | dict(zip(GIS, at, strict=True))
    return poses.join(transforms, "camera_id").withColumns(new).drop("t")


def pose_points(poses: DataFrame, transforms: DataFrame, z_weight: float) -> DataFrame:
    """Four points of every measurement, its origin and the ends of its axes (that of z drawn out): vx.. of the transformed visual pose, gx.. of the GNSS pose."""
    r, at = _times(lambda i, j: F.col("t")[4 * i + j], [F.col(c) for c in VROT], [F.col(c) for c in VIS])
    g = [[F.col(f"g{i}{j}") for j in range(3)] for i in range(3)]
    ends = []
    for axis, size in ((None, 0.0), (0, 1.0), (1, 1.0), (2, z_weight)):
        move = lambda m: [m[i][axis] * size if axis is not None else F.lit(0.0) for i in range(3)]
        vis, gis = move(r), move(g)
        ends.append(F.struct(*[(at[i] + vis[i]).alias(VIS[i]) for i in range(3)], *[(F.col(GIS[i]) + gis[i]).alias(GIS[i]) for i in range(3)]))
    return poses.join(transforms, "camera_id").select("camera_id", "seq", F.posexplode(F.array(*ends)).alias("point", "p")).select("camera_id", "seq", "point", "p.*")


def refined(poses: DataFrame, transforms: DataFrame, z_weight: float) -> DataFrame:
    """transforms (camera_id, t) improved by a similarity fit over the four points of every measurement; axes keep a straight track from turning."""
    fit = umeyama(pose_points(poses, transforms, z_weight))
    s = lambda i, j: F.col("scale") * F.col(f"r{i}{j}")
    move = ("tx", "ty", "tz")
    old = lambda k, j: F.col("t")[4 * k + j]
    new = [sum((s(i, k) * old(k, j) for k in range(3)), F.lit(0.0)) + (F.col(move[i]) if j == 3 else F.lit(0.0)) for i in range(3) for j in range(4)]
    return transforms.join(fit, "camera_id").select("camera_id", F.array(*new, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("t"))


def georef_init(poses: DataFrame, least_visual: float, min_frames: int, most_change: float | None = None, before: float = 0.0, z_weight: float = 5.0, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First georeference of each camera: (report, measurements kept, transforms).

    The report holds n_unique, the mean scale and whether the camera stands: with min_frames unique measurements at least, and a scale that
    differs from the one before by most_change at most, and more or fewer unique ones than an earlier try had (tried: camera_id, n_unique).
    Only cameras that stand have measurements and a transform."""
    judged = written(judged_unique(poses, least_visual), "georef-judged")  # the fold runs once; three results read it
    report = judged.groupBy("camera_id").agg(F.count_if("chosen").alias("n_unique"), (F.sum("total") / F.when(F.sum("n") > 0, F.sum("n"))).alias("scale"))
    stands = (F.col("n_unique") >= min_frames) & F.col("scale").isNotNull()
    if most_change is not None:
        stands &= F.abs(F.col("scale") - before) <= most_change
    if tried is not None:
        report = report.join(tried.select("camera_id", F.col("n_unique").alias("n_tried")), "camera_id", "left")
        stands &= F.coalesce(F.col("n_unique") != F.col("n_tried"), F.lit(True))
    report = report.withColumn("stands", stands).select("camera_id", "n_unique", "scale", "stands")
    ready = report.where("stands")
    kept = poses.join(judged.where("chosen").select("camera_id", "seq"), ["camera_id", "seq"], "left_semi").join(ready.select("camera_id"), "camera_id", "left_semi")
    size = lambda i, j: F.col("scale") if i == j and i < 3 else F.lit(float(i == j))
    first = ready.select("camera_id", F.array(*[size(i, j) for i in range(4) for j in range(4)]).alias("t"))
    return report, kept, refined(kept, first, z_weight)


def georef_update(kept: DataFrame, new: DataFrame, transforms: DataFrame, least_visual: float, z_weight: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(measurements, transforms) after one new measurement a camera: it counts if it gives a scale against the newest one kept."""
    last = kept.groupBy("camera_id").agg(F.max_by(F.struct(*GIS, *VIS), "seq").alias("last"))
    s = two_point_scale(F.col, lambda c: F.col("last")[c], least_visual)
    good = new.join(last, "camera_id").where(s > 0).select(*kept.columns)
    more = kept.unionByName(good)
    touched = good.select("camera_id").distinct()
    again = refined(more.join(touched, "camera_id", "left_semi"), transforms.join(touched, "camera_id", "left_semi"), z_weight)
    return more, transforms.join(touched, "camera_id", "left_anti").unionByName(again)


def without_scale(t) -> tuple[np.ndarray, float]:
    """A similarity as a rigid 4 x 4 transform, and its scale."""
    t = np.array(t, float)
    scale = float(np.linalg.norm(t[:3, 0]))
    if scale <= 0:
        raise ValueError("a similarity has a scale above 0")
    rigid = t.copy()
    rigid[:3, :3] /= scale
    return rigid, scale


def georeference_difference(old, new) -> np.ndarray:
    """The transform that leads points of an old georeference to a new one, with the change of scale."""
    (a, size_a), (b, size_b) = without_scale(old), without_scale(new)
    diff = np.linalg.inv(a) @ b
    diff[:3, :3] *= size_b / size_a
    return diff


def pose_guess(frames: DataFrame, t, cols=("easting", "northing", "altitude")) -> DataFrame:
    """vx, vy, vz: where a frame's default position lies in the visual frame of a georeference."""
    rigid, scale = without_scale(t)
    back = np.linalg.inv(rigid)
    p = [F.col(c) for c in cols]
    at = [sum((float(back[i, j]) * p[j] for j in range(3)), F.lit(float(back[i, 3]))) / scale for i in range(3)]
    return frames.withColumns(dict(zip(VIS, at, strict=True)))
