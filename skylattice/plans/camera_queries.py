"""Queries of cameras, poses, rectification and georeferencing."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import camera as C
from skylattice.operators import georef
from skylattice.operators.rectify import footprints, rectify, visible_cells
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import FRAMES, POSES, frames, poses

CAMERA = C.Pinhole(1200.0, 1200.0, 600.0, 500.0, 1200, 1000)
_CS = "select *, cos(radians(-heading)) as c, sin(radians(-heading)) as s from frames"


@query("heading_rotation", f"with {FRAMES}, f as ({_CS}) select frame_id, round(c, 6) + 0 as r00, round(s, 6) + 0 as r01, round(s, 6) + 0 as r10, round(-c, 6) + 0 as r11 from f")
def heading_rotation(spark, sf_dir):
    r = C.heading_rotation(F.col("heading"))
    return frames(spark, sf_dir).select("frame_id", *[(F.round(r[i][j], 6) + 0).alias(f"r{i}{j}") for i in (0, 1) for j in (0, 1)])


@query("default_pose", f"with {FRAMES} select frame_id, case when has_pose = 1 then easting + 0.5e0 else easting end as px, case when has_pose = 1 then northing - 0.5e0 else northing end as py, altitude as pz from frames")
def default_pose(spark, sf_dir):
    at = (F.col("easting"), F.col("northing"), F.col("altitude"))
    visual = (F.col("easting") + 0.5, F.col("northing") - 0.5, F.col("altitude"))
    pose = C.frame_pose(F.col("has_pose") == 1, visual, at)
    return frames(spark, sf_dir).select("frame_id", *[p.alias(c) for p, c in zip(pose, ("px", "py", "pz"), strict=True)])


@query("projection_matrix", f"""with {FRAMES}, f as ({_CS}) select frame_id, round(1200 * c, 4) + 0 as p00, round(1200 * s, 4) + 0 as p01, round(-600e0, 4) as p02,
    round(1200 * -(c * (easting - 604000) + s * (northing - 5792000)) + 600 * altitude, 3) + 0 as p03 from f""")
def projection_matrix(spark, sf_dir):
    f = frames(spark, sf_dir)
    t = (F.col("easting") - 604000, F.col("northing") - 5792000, F.col("altitude"))
    p = C.projection_matrix(CAMERA, C.heading_rotation(F.col("heading")), t)[0]
    return f.select("frame_id", (F.round(p[0], 4) + 0).alias("p00"), (F.round(p[1], 4) + 0).alias("p01"), F.round(p[2], 4).alias("p02"), (F.round(p[3], 3) + 0).alias("p03"))


_CORNERS = f"""with {FRAMES}, f as ({_CS}), k as (select * from (values (0e0, 0e0), (0e0, 1000e0), (1200e0, 1000e0), (1200e0, 0e0)) t(u, v)),
    g as (select frame_id, camera_id, ts, easting + altitude * (c * (u - 600) / 1200 + s * (v - 500) / 1200) as x, northing + altitude * (s * (u - 600) / 1200 - c * (v - 500) / 1200) as y from f, k),
    b as (select frame_id, camera_id, ts, min(x) as x, min(y) as y, max(x) - min(x) as width, max(y) - min(y) as height from g group by all)"""


@query("project_roi", f"{_CORNERS} select frame_id, round(x, 3) as x, round(y, 3) as y, round(width, 3) as width, round(height, 3) as height from b")
def project_roi(spark, sf_dir):
    return footprints(frames(spark, sf_dir), CAMERA).select("frame_id", *[F.round(c, 3).alias(c) for c in ("x", "y", "width", "height")])


_CELLS = f"""{_CORNERS}, o as (select b.frame_id, unnest(range(cast(ceil(x / 25) as bigint), cast(floor((x + width) / 25) as bigint) + 1)) as gx, y, height from b),
    l as (select frame_id, gx, unnest(range(cast(ceil(y / 25) as bigint), cast(floor((y + height) / 25) as bigint) + 1)) as gy from o),
    w as (select frame_id, gx, gy, c * (gx * 25e0 - easting) + s * (gy * 25e0 - northing) as xc, s * (gx * 25e0 - easting) - c * (gy * 25e0 - northing) as yc, altitude - 10e0 as zc,
      easting - gx * 25e0 as dx, northing - gy * 25e0 as dy from l join f using (frame_id)),
    i as (select *, 1200 * xc / zc + 600 as u, 1200 * yc / zc + 500 as v from w),
    h as (select frame_id, gx, gy, cast(floor(u) as int) as px, cast(floor(v) as int) as py, acos(sqrt(dx * dx + dy * dy) / sqrt(dx * dx + dy * dy + zc * zc)) * 180 / 3.1415e0 as angle from i where u > 0 and u < 1200 and v > 0 and v < 1000)"""


@query("rectify_cells", f"{_CELLS} select frame_id, gx, gy, px, py, round(angle, 4) as angle from h")
def rectify_cells(spark, sf_dir):
    return rectify(frames(spark, sf_dir), CAMERA, 25.0, 10.0).select("frame_id", "gx", "gy", "px", "py", F.round("angle", 4).alias("angle"))


@query("elevation_angle", f"{_CELLS} select gx, gy, count(*) as n, round(max(angle), 4) as best_angle from h group by gx, gy")
def elevation_angle(spark, sf_dir):
    return visible_cells(frames(spark, sf_dir), CAMERA, 25.0, 10.0).withColumn("best_angle", F.round("best_angle", 4))


@query("overlap_pct", f"""{_CORNERS}, p as (select *, lag(x) over w as px, lag(y) over w as py, lag(width) over w as pw, lag(height) over w as ph from b window w as (partition by camera_id order by ts, frame_id)),
    a as (select *, least(x + width, px + pw) - greatest(x, px) as ow, least(y + height, py + ph) - greatest(y, py) as oh from p)
    select frame_id, case when px is not null then round(case when ow > 0 and oh > 0 then ow * oh else 0 end / (width * height) * 100, 4) end as overlap from a""")
def overlap_pct(spark, sf_dir):
    from skylattice.operators.stages import overlap_with_previous

    return overlap_with_previous(footprints(frames(spark, sf_dir), CAMERA)).select("frame_id", F.round("overlap", 4).alias("overlap"))


#: The frames of each camera in order, each with the rectangle published last: a fold, as recursion.
FOLD = """tr as (select b.*, fr.is_keyframe, fr.has_pose, row_number() over (partition by b.camera_id order by b.ts, b.frame_id) as rn from b join (select frame_id, is_keyframe, has_pose from frames) fr using (frame_id)),
  fold as (select camera_id, rn, frame_id, x, y, width, height, {first} as why from tr where rn = 1 union all
    select camera_id, rn, frame_id, case when why is not null then nx else x end, case when why is not null then ny else y end, case when why is not null then nw else width end, case when why is not null then nh else height end, why from (
      select *, {rule} as why from (
        select tr.camera_id, tr.rn, tr.frame_id, fold.x, fold.y, fold.width, fold.height, tr.x as nx, tr.y as ny, tr.width as nw, tr.height as nh, tr.is_keyframe, tr.has_pose,
          case when fold.x is null then 0 else 100 * greatest(least(tr.x + tr.width, fold.x + fold.width) - greatest(tr.x, fold.x), 0) * greatest(least(tr.y + tr.height, fold.y + fold.height) - greatest(tr.y, fold.y), 0) / (tr.width * tr.height) end as overlap
        from fold join tr on tr.camera_id = fold.camera_id and tr.rn = fold.rn + 1) j) k)"""


@query("throttle_publish", _CORNERS.replace("with ", "with recursive ", 1) + ", " + FOLD.format(first="'first'", rule="case when overlap < 30 then 'next' end") + " select camera_id, frame_id from fold where why is not null")
def throttle_publish(spark, sf_dir):
    from skylattice.operators.stages import throttled

    return throttled(footprints(frames(spark, sf_dir), CAMERA), 30.0)


@query("baseline", f"""with {FRAMES} select frame_id, round(sqrt(power(easting - lag(easting) over w, 2) + power(northing - lag(northing) over w, 2) + power(altitude - lag(altitude) over w, 2)), 4) as baseline
    from frames window w as (partition by camera_id order by ts, frame_id)""")
def baseline(spark, sf_dir):
    from skylattice.operators.stages import sequence

    cols = ("easting", "northing", "altitude")
    d = C.distance(tuple(F.col(c) for c in cols), tuple(F.lag(c).over(sequence()) for c in cols))
    return frames(spark, sf_dir).select("frame_id", F.round(d, 4).alias("baseline"))


@query("camera_resize", f"with {FRAMES} select frame_id, round(300 * (easting - 604500) / altitude + 150, 4) as u, round(300 * (northing - 5792250) / altitude + 125, 4) as v from frames")
def camera_resize(spark, sf_dir):
    u, v = CAMERA.resized(0.25).to_image(F.col("easting") - 604500, F.col("northing") - 5792250, F.col("altitude"))
    return frames(spark, sf_dir).select("frame_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


@query("undistort_points", f"""with {FRAMES}, a as (select frame_id, (frame_id % 1200) * 1e0 as u, (frame_id % 1000) * 1e0 as v from frames),
    n as (select frame_id, (u - 600) / 1200 as x, (v - 500) / 1200 as y from a), r as (select *, x * x + y * y as r2 from n)
    select frame_id, round((x * (1 + r2 * (-0.1e0 + r2 * 0.02e0)) + 2 * 0.001e0 * x * y + 0.002e0 * (r2 + 2 * x * x)) * 1200 + 600, 4) as u,
      round((y * (1 + r2 * (-0.1e0 + r2 * 0.02e0)) + 0.001e0 * (r2 + 2 * y * y) + 2 * 0.002e0 * x * y) * 1200 + 500, 4) as v from r""")
def undistort_points(spark, sf_dir):
    lens = C.Pinhole(1200.0, 1200.0, 600.0, 500.0, 1200, 1000, k1=-0.1, k2=0.02, p1=0.001, p2=0.002)
    u, v = lens.distorted((F.col("frame_id") % 1200) * 1.0, (F.col("frame_id") % 1000) * 1.0)
    return frames(spark, sf_dir).select("frame_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


# ---------------------------------------------------------------- georeferencing

_T = [[4.0, 0.1, 0.0, 3.0], [-0.1, 4.0, 0.0, -2.0], [0.0, 0.0, 4.0, 0.5], [0.0, 0.0, 0.0, 1.0]]
_GIS = "sqrt(power(gx - {0}, 2) + power(gy - {1}, 2) + power(gz - {2}, 2))"


@query("two_point_scale", f"""with {POSES}, p as (select *, lag(gx) over w as ax, lag(gy) over w as ay, lag(vx) over w as bx, lag(vy) over w as by_, lag(seq) over w as before from poses window w as (partition by camera_id order by seq)),
    d as (select seq, sqrt(power(gx - ax, 2) + power(gy - ay, 2)) as g, sqrt(power(vx - bx, 2) + power(vy - by_, 2)) as v from p where before is not null)
    select seq, round(case when g > 10 and v > 2 then g / v else -1 end, 5) as scale from d""")
def two_point_scale(spark, sf_dir):
    return georef.scales(poses(spark, sf_dir), 2.0).select("seq", F.round("scale", 5).alias("scale"))


@query("reference_error", f"""with {POSES} select camera_id, count(*) as n, round(avg(sqrt(power(4 * vx + 0.1e0 * vy + 3 - gx, 2) + power(-0.1e0 * vx + 4 * vy - 2 - gy, 2) + power(4 * vz + 0.5e0 - gz, 2))), 5) as error from poses group by camera_id""")
def reference_error(spark, sf_dir):
    return georef.reference_error(poses(spark, sf_dir), _T).select("camera_id", "n", F.round("error", 5).alias("error"))


@query("apply_transform", f"with {POSES} select seq, round(4 * vx + 0.1e0 * vy + 3, 6) as vx, round(-0.1e0 * vx + 4 * vy - 2, 6) as vy, round(4 * vz + 0.5e0, 6) as vz from poses")
def apply_transform(spark, sf_dir):
    return georef.apply_transform(poses(spark, sf_dir), _T, georef.VIS).select("seq", *[F.round(c, 6).alias(c) for c in georef.VIS])


@query("scale_drift", f"""with {POSES}, r as (select *, row_number() over (partition by camera_id order by seq) - 1 as nth, count(*) over (partition by camera_id) as n from poses),
    l as (select camera_id, gx as lx, gy as ly, vx as mx, vy as my from r where nth = n - 1),
    d as (select camera_id, sqrt(power(gx - lx, 2) + power(gy - ly, 2)) as g, sqrt(power(vx - mx, 2) + power(vy - my, 2)) as v from r join l using (camera_id) where nth % greatest(1, (n - 1) // 3) = 0 and nth < n - 1),
    s as (select camera_id, case when g > 10 and v > 2 then g / v end as s from d)
    select camera_id, round(case when count(s) >= 2 then abs(1 - avg(s) / 4) * 100 else -1 end, 5) as drift from s group by camera_id""")
def scale_drift(spark, sf_dir):
    return georef.scale_drift(poses(spark, sf_dir), 4.0, 2.0).select("camera_id", F.round("drift", 5).alias("drift"))


@query("umeyama_fit")
def umeyama_fit(spark, sf_dir):
    fit = georef.umeyama(poses(spark, sf_dir))
    return fit.select("camera_id", "n", *[F.round(c, 5).alias(c) for c in fit.columns if c not in ("camera_id", "n")])


@query("georef_greedy")
def georef_greedy(spark, sf_dir):
    return georef.greedy_unique(poses(spark, sf_dir), 2.0)


_TURN = [[0.0, -4.0, 0.0, 604000.0], [4.0, 0.0, 0.0, 5792000.0], [0.0, 0.0, 4.0, 50.0], [0.0, 0.0, 0.0, 1.0]]


@query("pose_guess", f"with {FRAMES} select frame_id, round((northing - 5792000) / 4, 6) + 0 as vx, round(-(easting - 604000) / 4, 6) + 0 as vy, round((altitude - 50) / 4, 6) + 0 as vz from frames")
def pose_guess(spark, sf_dir):
    return georef.pose_guess(frames(spark, sf_dir), _TURN).select("frame_id", *[(F.round(c, 6) + 0).alias(c) for c in georef.VIS])
