"""Queries of the stage chains: dense clouds, surfaces, orthophotos, georeferences, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.camera import Pinhole, heading_rotation
from skylattice.operators import algebra, georef, mosaic, rectify, stages, surface
from skylattice.operators import depth as D
from skylattice.operators import tiles as T
from skylattice.plans.camera_queries import _CORNERS, CAMERA, FOLD
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import DEPTH, FRAMES, OBS, ORDER, POINTS, POSES, STRIDE, depth_maps, frames, observations, points, poses, strip, table
from skylattice.plans.mosaic_queries import MOSAIC

SMALL = Pinhole(60.0, 60.0, 25.0, 20.0, 50, 40)


def shots(spark, sf_dir):
    """Poses of the frames that have depth maps and images."""
    k = F.col("frame_id")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8 + 8 * strip("l_orderkey")).alias("frame_id")).distinct().select(
        "frame_id", (12.0 + 5 * k).alias("easting"), (14.0 + 4 * (k % 8)).alias("northing"), (95.0 + k % 8).alias("altitude"), (45.0 * k).alias("heading"),
        (k % 2).cast("int").alias("is_keyframe"), F.lit(1).alias("has_pose"),
    )


SHOTS = f"""shots as (select i as frame_id, 12e0 + 5 * i as easting, 14e0 + 4 * (i % 8) as northing, 95e0 + i % 8 as altitude, 45e0 * i as heading, i % 2 as is_keyframe, 1 as has_pose,
  cos(radians(-45e0 * i)) as c, sin(radians(-45e0 * i)) as s from (select distinct l_suppkey % 8 + 8 * (l_orderkey // {STRIDE}) as i from lineitem))"""


def images(spark, sf_dir):
    """Pixels of the frames; the earliest row of each pixel counts."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8 + 8 * strip("l_orderkey")).alias("frame_id"), (F.col("l_partkey") % 40).alias("r"), (F.col("l_orderkey") % 50).alias("c"), F.struct(F.struct(*ORDER).alias("seq"), F.col("l_extendedprice").alias("color")).alias("x")
    )
    return rows.groupBy("frame_id", "r", "c").agg(F.min("x").alias("x")).select("frame_id", "r", "c", "x.color")


IMAGES = f"""images as (select frame_id, r, c as col, color from (select l_suppkey % 8 + 8 * (l_orderkey // {STRIDE}) as frame_id, l_partkey % 40 as r, l_orderkey % 50 as c, l_extendedprice as color,
  row_number() over (partition by l_suppkey % 8 + 8 * (l_orderkey // {STRIDE}), l_partkey % 40, l_orderkey % 50 order by {", ".join(ORDER)}) as rn from lineitem) where rn = 1)"""


@query("surface_planar", f"""{_CORNERS}, o as (select frame_id, unnest(range(cast(ceil(x / 50) as bigint), cast(floor((x + width) / 50) as bigint) + 1)) as gx, y, height from b)
    select frame_id, gx, unnest(range(cast(ceil(y / 50) as bigint), cast(floor((y + height) / 50) as bigint) + 1)) as gy, 10e0 as elevation from o""")
def surface_planar(spark, sf_dir):
    boxes = rectify.footprints(frames(spark, sf_dir), CAMERA).withColumn("elevation", F.lit(10.0))
    return surface.planar(boxes, 50.0, "frame_id")


@query(
    "surface_normals",
    f"""with {POINTS}, q as (select i as gx, j as gy, i * 2e0 as qx, j * 2e0 as qy from (select unnest(range(50)) as i) cross join (select unnest(range(50)) as j)),
    p as (select x, y, z from points), d as (select gx, gy, x, y, z, (x - qx) * (x - qx) + (y - qy) * (y - qy) as d2 from q, p where (x - qx) * (x - qx) + (y - qy) * (y - qy) < 10),
    ring as (select gx, gy, ring from (select gx, gy, floor(d2 / 2) + 1 as ring, row_number() over (partition by gx, gy order by d2) as rn from d) where rn = 3 and ring < 6),
    u as (select *, row_number() over (partition by gx, gy order by d2 desc, x, y, z) as k from d join ring using (gx, gy) where d2 < ring * 2),
    e as (select gx, gy, coalesce(avg(z) filter (d2 = 0), sum(z / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) as elevation from u group by gx, gy),
    t as (select gx, gy, max(x) filter (k = 1) ax, max(y) filter (k = 1) ay, max(z) filter (k = 1) az, max(x) filter (k = 2) bx, max(y) filter (k = 2) by_, max(z) filter (k = 2) bz,
      max(x) filter (k = 3) cx, max(y) filter (k = 3) cy, max(z) filter (k = 3) cz from u group by gx, gy),
    n as (select gx, gy, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as x, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as y, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as z from t)
    select gx, gy, round(elevation, 4) as elevation, round(abs(z) / nullif(sqrt(x*x + y*y + z*z), 0), 3) as nz from e join n using (gx, gy) where abs(z) > 1e-6 * sqrt(x*x + y*y + z*z)""",
)
def surface_normals(spark, sf_dir):
    got = surface.elevation_surface(points(spark, sf_dir), 2.0, (0, 0, 49, 49), 6, "furthest", blur=False)
    return got.where("nz > 1e-6").select("gx", "gy", F.round("elevation", 4).alias("elevation"), F.round("nz", 3).alias("nz"))


_NORMALS = f"""with {POINTS}, q as (select i as gx, j as gy, i * 2e0 as qx, j * 2e0 as qy from (select unnest(range(50)) as i) cross join (select unnest(range(50)) as j)),
    p as (select x, y, z from points), d as (select gx, gy, x, y, z, (x - qx) * (x - qx) + (y - qy) * (y - qy) as d2 from q, p where (x - qx) * (x - qx) + (y - qy) * (y - qy) < 10),
    ring as (select gx, gy, ring from (select gx, gy, floor(d2 / 2) + 1 as ring, row_number() over (partition by gx, gy order by d2) as rn from d) where rn = 3 and ring < 6),
    u as (select *, row_number() over (partition by gx, gy order by d2 desc, x, y, z) as k from d join ring using (gx, gy) where d2 < ring * 2),
    t as (select gx, gy, max(x) filter (k = 1) ax, max(y) filter (k = 1) ay, max(z) filter (k = 1) az, max(x) filter (k = 2) bx, max(y) filter (k = 2) by_, max(z) filter (k = 2) bz,
      max(x) filter (k = 3) cx, max(y) filter (k = 3) cy, max(z) filter (k = 3) cz from u group by gx, gy),
    n as (select gx, gy, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as x, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as y, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as z from t),
    v as materialized (select gx, gy, case when z < 0 then -x else x end / l as nx, case when z < 0 then -y else y end / l as ny, abs(z) / l as nz from (select *, nullif(sqrt(x*x + y*y + z*z), 0) as l from n))"""


@query("surface_normals_smooth", f"""{_NORMALS}, o as (select unnest(range(-2, 3)) as d), s as (select gx + i.d as gx, gy + j.d as gy, nx, ny, nz from v, o i, o j)
    select v.gx, v.gy, round(median(s.nx), 3) + 0 as nx, round(median(s.ny), 3) + 0 as ny, round(median(s.nz), 3) + 0 as nz from v join s using (gx, gy) where v.nx is not null group by v.gx, v.gy""")
def surface_normals_smooth(spark, sf_dir):
    got = surface.elevation_surface(points(spark, sf_dir), 2.0, (0, 0, 49, 49), 6, "furthest")
    return got.where("nx is not null").select("gx", "gy", *[(F.round(c, 3) + 0).alias(c) for c in ("nx", "ny", "nz")])


@query("surface_best_fit")
def surface_best_fit(spark, sf_dir):
    got = surface.elevation_surface(points(spark, sf_dir), 2.0, (0, 0, 49, 49), 6, "best")
    return got.select("gx", "gy", *[F.round(c, 4).alias(c) for c in ("elevation", "nx", "ny", "nz")])


_CLAMPED = f"""{DEPTH}, {SHOTS}, med as (select frame_id, quantile_disc(depth, 0.5) as m from depth where depth > 0 group by frame_id),
    k as (select frame_id, r, c as col, case when depth between 0.9e0 * m and 1.1e0 * m then depth end as depth from depth left join med using (frame_id)),
    v as (select a.frame_id, a.r, a.col, a.depth, coalesce(sum(case when abs(b.depth - a.depth) / a.depth < 0.1 then 1 else 0 end), 0) as votes from k a
      left join k b on b.r = a.r and b.col = a.col and b.frame_id <> a.frame_id and b.frame_id between a.frame_id - 2 and a.frame_id + 1 and b.depth > 0 where a.depth > 0 group by all),
    stays as (select frame_id from v group by frame_id having 100 * avg(case when votes >= 2 then 1e0 else 0e0 end) >= 5)"""


@query("dense_points", f"""with {_CLAMPED} select frame_id, r, col, round(easting + c * ((col - 25e0) / 60 * depth) + s * ((r - 20e0) / 60 * depth), 4) as x,
    round(northing + s * ((col - 25e0) / 60 * depth) - c * ((r - 20e0) / 60 * depth), 4) as y, round(altitude - depth, 4) as z from v join shots using (frame_id) where votes >= 2 and frame_id in (select frame_id from stays)""")
def dense_points(spark, sf_dir):
    clamped = D.clamp(depth_maps(spark, sf_dir), 0.9, 1.1)
    voted = D.votes(clamped)
    stays = D.coverage(voted, 5.0).where("stays").select("frame_id")
    kept = voted.where("kept").join(stays, "frame_id", "left_semi")
    got = D.placed(kept, shots(spark, sf_dir), SMALL)
    return got.select("frame_id", "r", F.col("c").alias("col"), *[F.round(x, 4).alias(x) for x in ("x", "y", "z")])


_ORTHO = f"""{OBS}, {SHOTS}, {IMAGES}, g as (select gx, gy, min(elevation) as elevation from obs where elevation is not null group by gx, gy),
    w as (select frame_id, gx, gy, elevation, c * (gx - easting) + s * (gy - northing) as xc, s * (gx - easting) - c * (gy - northing) as yc, altitude - elevation as zc, easting - gx as dx, northing - gy as dy, is_keyframe from g, shots),
    h as (select *, 60 * xc / zc + 25 as u, 60 * yc / zc + 20 as v from w where zc > 0),
    ortho as (select h.frame_id, gx, gy, color, elevation, acos(sqrt(dx * dx + dy * dy) / sqrt(dx * dx + dy * dy + zc * zc)) * 180 / 3.1415e0 as angle, case when is_keyframe = 1 then 0 else 255 end as elevated
      from h left join images i on i.frame_id = h.frame_id and i.r = cast(floor(v) as bigint) and i.col = cast(floor(u) as bigint) where u > 0 and u < 50 and v > 0 and v < 40)"""


def _ortho(spark, sf_dir):
    seen = shots(spark, sf_dir)
    cells = observations(spark, sf_dir).where("elevation is not null").groupBy("gx", "gy").agg(F.min("elevation").alias("elevation"))
    kinds = surface.assumptions(seen, seen).select("frame_id", "assumption")
    return rectify.orthophotos_of_map(seen.join(kinds, "frame_id"), cells, images(spark, sf_dir), SMALL, 1.0)


@query("ortho_frames", f"with {_ORTHO} select frame_id, gx, gy, color, elevation, round(angle, 4) as angle, elevated, 1 as n_obs from ortho")
def ortho_frames(spark, sf_dir):
    return _ortho(spark, sf_dir).withColumn("angle", F.round("angle", 4))


@query("ortho_mosaic", f"""with {_ORTHO}, obs2 as (select *, frame_id as seq from ortho), r as (select *, max(angle) over (partition by gx, gy order by seq rows between unbounded preceding and 1 preceding) as best from obs2 where angle > 0)
    , m as (select gx, gy, arg_min({{'c': color, 'e': elevation}}, {{'a': -angle, 's': seq}}) as b, max(angle) as angle, cast(sum(case when best is null or angle > best then 1 else 0 end) as bigint) as n_obs from r group by gx, gy)
    select gx, gy, b.c as color, b.e as elevation, round(angle, 4) as angle, n_obs from m""")
def ortho_mosaic(spark, sf_dir):
    return mosaic.blend(_ortho(spark, sf_dir).withColumn("seq", F.col("frame_id"))).withColumn("angle", F.round("angle", 4))


# ---------------------------------------------------------------- georeference chain


def _posed(spark, sf_dir):
    """Measurements with orientation: the visual one is turned by 90 degrees against the GNSS one."""
    p = poses(spark, sf_dir)
    turn = (F.col("seq") % 36) * 10.0
    return p.withColumns({f"{k}{i}{j}": m[i][j] for k, m in (("g", heading_rotation(turn)), ("v", heading_rotation(turn))) for i in range(3) for j in range(3)})


_T = [4.0, 0.0, 0.0, 3.0, 0.0, 4.0, 0.0, -2.0, 0.0, 0.0, 4.0, 0.5, 0.0, 0.0, 0.0, 1.0]


@query("georef_apply", f"with {POSES} select seq, round(4 * vx + 3, 6) as gx, round(4 * vy - 2, 6) as gy, round(4 * vz + 0.5e0, 6) as gz, round(cos(radians((seq % 36) * -10e0)), 6) + 0 as g00, round(-cos(radians((seq % 36) * -10e0)), 6) + 0 as g11 from poses")
def georef_apply(spark, sf_dir):
    p = _posed(spark, sf_dir)
    t = p.select("camera_id").distinct().withColumn("t", F.array(*[F.lit(x) for x in _T]))
    return georef.georeferenced(p, t).select("seq", *[F.round(c, 6).alias(c) for c in georef.GIS], *[(F.round(c, 6) + 0).alias(c) for c in ("g00", "g11")])


@query("georef_points", f"""with {POSES}, a as (select *, cos(radians((seq % 36) * -10e0)) as c, sin(radians((seq % 36) * -10e0)) as s from poses)
    select seq, k, round(4 * vx + 3 + case k when 1 then c when 2 then s else 0 end, 5) + 0 as vx, round(gx + case k when 1 then c when 2 then s else 0 end, 5) + 0 as gx, round(gz - case k when 3 then 5 else 0 end, 5) as gz
    from a, (select unnest(range(4)) as k)""")
def georef_points(spark, sf_dir):
    p = _posed(spark, sf_dir)
    t = p.select("camera_id").distinct().withColumn("t", F.array(*[F.lit(x) for x in _T]))
    four = georef.pose_points(p, t, 5.0)
    return four.select("seq", F.col("point").cast("long").alias("k"), (F.round("vx", 5) + 0).alias("vx"), (F.round("gx", 5) + 0).alias("gx"), F.round("gz", 5).alias("gz"))


@query("georef_init")
def georef_init(spark, sf_dir):
    report, _, fitted = georef.georef_init(_posed(spark, sf_dir), 2.0, 3)
    return report.join(fitted, "camera_id", "left").select("camera_id", "n_unique", F.round("scale", 5).alias("scale"), "stands", F.transform("t", lambda x: F.round(x, 4)).alias("t"))


@query("georef_refine")
def georef_refine(spark, sf_dir):
    p = _posed(spark, sf_dir)
    t = p.select("camera_id").distinct().withColumn("t", F.array(*[F.lit(x) for x in _T]))
    return georef.refined(p, t, 3.0).select("camera_id", F.transform("t", lambda x: F.round(x, 4)).alias("t"))


@query("georef_by_moments")
def georef_by_moments(spark, sf_dir):
    from skylattice.operators import georef_state

    p = _posed(spark, sf_dir)
    t = p.select("camera_id").distinct().withColumn("t", F.array(*[F.lit(x) for x in _T]))
    return georef_state.refined_by_moments(georef_state.pose_moments(p), t, 3.0).select("camera_id", F.transform("t", lambda x: F.round(x, 4)).alias("t"))


# ---------------------------------------------------------------- publishing, tiles, colours


_WHY = "case when is_keyframe = 1 and overlap < 60 then 'keyframe' when has_pose = 0 and overlap < 30 then 'fallback' end"
_NONE = "case when is_keyframe = 1 then 'keyframe' when has_pose = 0 then 'fallback' end"
_PUBLISHED = FOLD.format(first=_NONE, rule=_WHY).replace("frame_id, x, y, width, height, case when is_keyframe", "frame_id, case when is_keyframe = 1 or has_pose = 0 then x end as x, y, width, height, case when is_keyframe", 1)


@query("published_frames", _CORNERS.replace("with ", "with recursive ", 1) + f", {_PUBLISHED} select camera_id, frame_id, why from fold where why is not null")
def published_frames(spark, sf_dir):
    return stages.published(rectify.footprints(frames(spark, sf_dir), CAMERA), 60.0, 30.0, use_fallback=True)


_DEPTHS = "select event_type as stage, event_id % 7 as depth, 5 as capacity from events"


@query("queue_statistics", f"with q as ({_DEPTHS}) select stage, count(*) as n, min(depth) as min, max(depth) as max, avg(depth) as mean, count(*) filter (depth >= capacity) as n_full from q group by stage")
def queue_statistics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 7).alias("depth"), F.lit(5).alias("capacity"))
    return stages.queue_statistics(e)


@query("keyframe_links", f"with {FRAMES} select camera_id, frame_id, last_value(case when is_keyframe = 1 then frame_id end ignore nulls) over (partition by camera_id order by ts, frame_id rows between unbounded preceding and current row) as link from frames qualify count(*) over (partition by camera_id, ts) = 1")
def keyframe_links(spark, sf_dir):
    from pyspark.sql import Window as W

    f = frames(spark, sf_dir)
    marks = f.where("is_keyframe = 1").select("camera_id", F.col("frame_id").alias("keyframe_id"), "ts")
    alone = f.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("camera_id", "ts"))).where("n = 1").select("camera_id", "frame_id")
    return stages.keyframe_links(f, marks).join(alone, ["camera_id", "frame_id"], "left_semi")


@query("tile_meters", "select tx, ty, round(tx * (40075016.685578488e0 / 1024) - 20037508.342789244e0, 4) as x, round(ty * (40075016.685578488e0 / 1024) - 20037508.342789244e0, 4) as y, round(40075016.685578488e0 / 1024, 4) as width from (select distinct c_custkey % 1024 as tx, c_nationkey as ty from customer)")
def tile_meters(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1024).alias("tx"), F.col("c_nationkey").alias("ty")).distinct()
    return T.tile_meters(t, 10).select("tx", "ty", *[F.round(c, 4).alias(c) for c in ("x", "y", "width")])


@query("resample_to", f"with {OBS}, {MOSAIC} select gx, gy, elevation from (select cast(floor(i / 2.5e0 + 0.5e0) as bigint) as mx, i as gx from (select unnest(range(-10, 200)) as i)) a, (select cast(floor(j / 2.5e0 + 0.5e0) as bigint) as my, j as gy from (select unnest(range(-10, 200)) as j)) b join (select gx as ox, gy as oy, elevation from m) on ox = mx and oy = my")
def resample_to(spark, sf_dir):
    return algebra.resample_to(mosaic.blend(observations(spark, sf_dir)), 2.5, 1.0, "elevation")


_LEVEL = "floor(255 * greatest(0, least(1, 1.5e0 - abs(4 * (level / 255e0) - {0}))) + 0.5)"


@query("color_map", f"with {OBS}, {MOSAIC}, s as (select min(elevation) as lo, max(elevation) as hi from m), l as (select gx, gy, cast(floor(255e0 * (elevation - lo) / (hi - lo) + 0.5e0) as int) as level from m, s) select gx, gy, cast({_LEVEL.format(3)} as int) as red, cast({_LEVEL.format(2)} as int) as green, cast({_LEVEL.format(1)} as int) as blue from l")
def color_map(spark, sf_dir):
    scaled = algebra.color_scale(mosaic.blend(observations(spark, sf_dir)), "elevation")
    return scaled.select("gx", "gy", *[v.alias(c) for v, c in zip(algebra.jet(F.col("level")), ("red", "green", "blue"), strict=True)])


@query("normal_colors", f"with {POINTS}, n as (select nx / sqrt(nx*nx + ny*ny + 1) as a, ny / sqrt(nx*nx + ny*ny + 1) as b, 1 / sqrt(nx*nx + ny*ny + 1) as c from points) select cast(floor((a + 1) * 127.5e0 + 0.5) as int) as red, cast(floor((b + 1) * 127.5e0 + 0.5) as int) as green, cast(floor((c + 1) * 127.5e0 + 0.5) as int) as blue, count(*) as n from n group by all")
def normal_colors(spark, sf_dir):
    from skylattice.operators.spatial import normalised

    n = normalised(points(spark, sf_dir), "nx", "ny", "nz")
    rgb = algebra.normal_colors(*[F.col(c) for c in ("nx", "ny", "nz")])
    return n.groupBy(*[v.alias(c) for v, c in zip(rgb, ("red", "green", "blue"), strict=True)]).agg(F.count(F.lit(1)).alias("n"))
