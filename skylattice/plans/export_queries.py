"""Queries of exports: clouds, meshes, overviews, metadata, text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import algebra, export
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import FRAMES, OBS, frames, observations, table
from skylattice.plans.mosaic_queries import MOSAIC
from skylattice.operators import mosaic


def _mosaic(spark, sf_dir):
    return mosaic.blend(observations(spark, sf_dir))


@query("cloud_export", f"with {OBS}, {MOSAIC} select gx, gy, gx * 0.5e0 as x, gy * 0.5e0 as y, elevation as z, color from m")
def cloud_export(spark, sf_dir):
    return export.cloud(_mosaic(spark, sf_dir), 0.5)


_MESH = f"""with {OBS}, {MOSAIC}, v as (select gx, gy from m), q as (select a.gx, a.gy from v a join v b on b.gx = a.gx + 1 and b.gy = a.gy join v c on c.gx = a.gx and c.gy = a.gy + 1 join v d on d.gx = a.gx + 1 and d.gy = a.gy + 1)
    select gx, gy, half, case half when 0 then gx else gx + 1 end as ax, gy as ay from q, (select unnest([0, 1]) as half)"""


@query("mesh_faces", _MESH)
@query("mesh_faces_all", _MESH)
def mesh_faces(spark, sf_dir):
    return export.mesh(_mosaic(spark, sf_dir)).select("gx", "gy", "half", F.col("a.gx").alias("ax"), F.col("a.gy").alias("ay"))


@query("color_scale", f"with {OBS}, {MOSAIC}, s as (select min(elevation) as lo, max(elevation) as hi from m) select gx, gy, cast(floor(255e0 * (elevation - lo) / (hi - lo) + 0.5e0) as int) as level from m, s")
def color_scale(spark, sf_dir):
    return algebra.color_scale(_mosaic(spark, sf_dir), "elevation")


@query("overview_levels", f"with {OBS}, {MOSAIC} select f as factor, gx // f as gx, gy // f as gy, color from m, (select unnest([2, 4, 8, 16]) as f) where gx % f = 0 and gy % f = 0")
def overview_levels(spark, sf_dir):
    return export.overviews(_mosaic(spark, sf_dir).select("gx", "gy", "color"), (2, 4, 8, 16))


@query("raster_metadata", f"with {OBS} select frame_id, min(gx) * 0.5e0 as x0, 0.5e0 as gsd, (max(gy)) * 0.5e0 as y_top, -0.5e0 as step, max(gx) - min(gx) + 1 as cols, max(gy) - min(gy) + 1 as rows from obs group by frame_id")
def raster_metadata(spark, sf_dir):
    return export.raster_metadata(observations(spark, sf_dir), 0.5, "frame_id")


@query("mvs_views", "select l_partkey as point_id, count(distinct l_suppkey) as n_views, min(l_suppkey) as first_view, min(l_quantity) as z from lineitem group by l_partkey")
def mvs_views(spark, sf_dir):
    views = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_suppkey").alias("view"), F.col("l_quantity").alias("z"))
    got = export.vertex_views(views)
    return got.select("point_id", F.size("views").cast("long").alias("n_views"), F.col("views")[0].alias("first_view"), "z")


@query("depth_scale", f"with {OBS}, s as (select frame_id, min(elevation) as lo, max(elevation) as hi from obs group by frame_id) select frame_id, gx, gy, cast(floor((elevation - lo) / nullif(hi - lo, 0) * 65535 + 0.5e0) as int) as level from obs join s using (frame_id) where elevation is not null")
def depth_scale(spark, sf_dir):
    return export.scaled_depth(observations(spark, sf_dir).select("frame_id", "gx", "gy", F.col("elevation").alias("depth")))


@query("file_names", f"with {FRAMES}, p as (select frame_id, '/data/flight_' || camera_id || '/frame_' || lpad(cast(frame_id as varchar), 6, '0') || '.png' as path from frames) select path, cast(right(split_part(split_part(path, '/', -1), '.', 1), 4) as bigint) as frame_no, len(string_split(path, '/')) as n_parts from p")
def file_names(spark, sf_dir):
    path = F.concat(F.lit("/data/flight_"), F.col("camera_id").cast("string"), F.lit("/"), export.file_name("frame", F.col("frame_id"), ".png"))
    p = frames(spark, sf_dir).select(path.alias("path"))
    return p.select("path", export.frame_number("path").alias("frame_no"), F.size(F.split("path", "/", -1)).cast("long").alias("n_parts"))


@query("xmp_tags", "select event_id, split_part(case when event_id % 2 = 0 then 'Xmp.' else 'Exif.' end || event_type || '.tag', '.', 1) = 'Xmp' as is_xmp from events")
def xmp_tags(spark, sf_dir):
    tag = F.concat(F.when(F.col("event_id") % 2 == 0, "Xmp.").otherwise("Exif."), F.col("event_type"), F.lit(".tag"))
    return table(spark, sf_dir, "events").select("event_id", (F.split_part(tag, F.lit("."), F.lit(1)) == "Xmp").alias("is_xmp"))


@query("gray_levels", "select l_orderkey, l_linenumber, round(0.299e0 * (l_partkey % 256) + 0.587e0 * (l_suppkey % 256) + 0.114e0 * (l_orderkey % 256), 3) as gray from lineitem")
def gray_levels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rgb = [F.col(c) % 256 for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    return li.select("l_orderkey", "l_linenumber", F.round(export.gray(*rgb), 3).alias("gray"))


@query("trajectory_tum", f"""with {FRAMES}, q as (select frame_id, cos(radians(-heading) / 2) as qx, sin(radians(-heading) / 2) as qy from frames)
    select frame_id, round(qx * qx - qy * qy, 6) + 0 as r00, round(2 * qx * qy, 6) + 0 as r01, round(qy * qy - qx * qx, 6) + 0 as r11 from q""")
def trajectory_tum(spark, sf_dir):
    half = F.radians(-F.col("heading")) / 2
    q = frames(spark, sf_dir).select("frame_id", F.cos(half).alias("qx"), F.sin(half).alias("qy"), F.lit(0.0).alias("qz"), F.lit(0.0).alias("qw"))
    r = export.quaternion_rotation("qx", "qy", "qz", "qw")
    return q.select("frame_id", (F.round(r[0][0], 6) + 0).alias("r00"), (F.round(r[0][1], 6) + 0).alias("r01"), (F.round(r[1][1], 6) + 0).alias("r11"))


@query("timing_report", "with t as (select event_type as step, cast(floor(value) as bigint) as ms from events) select step, count(*) as n, round(avg(ms), 6) as mean, round(stddev_samp(ms), 6) as stdev, min(ms) as min, max(ms) as max from t group by step")
def timing_report(spark, sf_dir):
    line = F.format_string("12:00:00 INFO Timing [%s]: %d ms", F.col("event_type"), F.floor("value"))
    got = export.timing_report(table(spark, sf_dir, "events").select(line.alias("value")))
    return got.select("step", "n", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "min", "max")
