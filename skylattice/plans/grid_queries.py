"""Queries of the grid algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.grid import GridSpec, contains, snap, snapped_size
from skylattice.operators import algebra
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import FRAMES, OBS, POINTS, frames, observations, points

SPEC = GridSpec(0.0, 0.0, 101.0, 101.0, 0.5)
#: A map per cell: the means that two halves of the observations see.
_CELLS = "select gx, gy, min(color) as color, min(elevation) as elevation, max(angle) as angle, max(elevated) as elevated from obs where"
_A, _B = f"{_CELLS} elevated = 255 and gx < 50 group by gx, gy", f"{_CELLS} elevated = 0 and gx >= 10 group by gx, gy"


def _cells(obs):
    return obs.groupBy("gx", "gy").agg(F.min("color").alias("color"), F.min("elevation").alias("elevation"), F.max("angle").alias("angle"), F.max("elevated").alias("elevated"))


def _sides(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return _cells(obs.where("elevated = 255 and gx < 50")), _cells(obs.where("elevated = 0 and gx >= 10"))


def _snap_sql(v, res):
    return f"case when abs({v} % {res}) < 1e-5 then {v} else {v} + case when {v} % {res} < 0 then -({v} % {res}) else {res} - {v} % {res} end end"


@query("grid_snap", f"with {POINTS} select round(x, 4) as x, round({_snap_sql('(x - 50e0)', '0.3e0')}, 6) as sx, count(*) as n from points group by all")
def grid_snap(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy(F.round("x", 4).alias("x"), F.round(snap(F.col("x") - 50.0, 0.3), 6).alias("sx")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "grid_index",
    f"""with {POINTS} select cast(trunc(round({_snap_sql('x', '0.5e0')} / 0.5e0)) as int) as col, cast(trunc(round((101e0 - ({_snap_sql('y', '0.5e0')})) / 0.5e0)) as int) as row, count(*) as n
    from points where x between -0.25 and 101.25 and y between -0.25 and 101.25 group by all""",
)
def grid_index(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    col, row = SPEC.index(x, y)
    return points(spark, sf_dir).where(SPEC.inside(x, y)).groupBy(col.alias("col"), row.alias("row")).agg(F.count(F.lit(1)).alias("n"))


@query("grid_position", f"with {OBS} select gx, gy, 3e0 + gx * 0.5e0 as x, 7e0 + 40e0 - gy * 0.5e0 as y, min(elevation) as z from obs group by gx, gy")
def grid_position(spark, sf_dir):
    x, y = GridSpec(3.0, 7.0, 40.0, 40.0, 0.5).position(F.col("gx"), F.col("gy"))
    return observations(spark, sf_dir).groupBy("gx", "gy").agg(F.min("elevation").alias("z")).select("gx", "gy", x.alias("x"), y.alias("y"), "z")


@query("grid_size", f"with {FRAMES} select frame_id, cast(trunc(round(({_snap_sql('altitude', '2e0')}) / 2e0)) + 1 as int) as cols from frames")
def grid_size(spark, sf_dir):
    return frames(spark, sf_dir).select("frame_id", snapped_size(F.col("altitude"), 2.0).alias("cols"))


@query(
    "grid_contains",
    f"""with {FRAMES} select frame_id, abs(greatest(least(604400e0, easting + 40e0) - greatest(604100e0, easting), 0e0) * greatest(least(5792300e0, northing + 30e0) - greatest(5792050e0, northing), 0e0)
    - 1200e0) < 1e-5 as inside from frames""",
)
def grid_contains(spark, sf_dir):
    lit = F.lit
    outer, inner = (lit(604100.0), lit(5792050.0), lit(300.0), lit(250.0)), (F.col("easting"), F.col("northing"), lit(40.0), lit(30.0))
    return frames(spark, sf_dir).select("frame_id", contains(outer, inner).alias("inside"))


@query("grid_crop_world", f"with {OBS} select gx, gy, color, elevation, angle from obs where gx * 0.5e0 between 5 and 20 and gy * 0.5e0 between 3 and 30")
def grid_crop_world(spark, sf_dir):
    return algebra.crop_world(observations(spark, sf_dir).select("gx", "gy", "color", "elevation", "angle"), 5.0, 3.0, 15.0, 27.0, 0.5)


@query("grid_crop_index", f"with {OBS} select gx, gy, color, elevated from obs where gx between 8 and 31 and gy between 20 and 43")
def grid_crop_index(spark, sf_dir):
    return algebra.crop(observations(spark, sf_dir).select("gx", "gy", "color", "elevated"), 8, 20, 31, 43)


@query(
    "grid_overlap",
    f"""with {OBS}, a as ({_A}), b as ({_B}) select gx, gy, a.color as l_color, a.elevation as l_elevation, a.angle as l_angle, a.elevated as l_elevated,
    b.color as r_color, b.elevation as r_elevation, b.angle as r_angle, b.elevated as r_elevated from a join b using (gx, gy)""",
)
def grid_overlap(spark, sf_dir):
    return algebra.overlap(*_sides(spark, sf_dir))


_MERGE = "select gx, gy, {0} as color, {1} as elevation, {2} as angle, {3} as elevated from (select *, true as there from a) a {join} join (select *, true as there from b) b using (gx, gy)"
_RIGHT = [f"case when b.there then b.{c} else a.{c} end" for c in ("color", "elevation", "angle", "elevated")]


@query("grid_upsert_left", f"with {OBS}, a as ({_A}), b as ({_B}) {_MERGE.format(*_RIGHT, join='left')}")
def grid_upsert_left(spark, sf_dir):
    return algebra.upsert(*_sides(spark, sf_dir))


@query("grid_upsert_full", f"with {OBS}, a as ({_A}), b as ({_B}) {_MERGE.format(*_RIGHT, join='full')}")
def grid_upsert_full(spark, sf_dir):
    return algebra.upsert(*_sides(spark, sf_dir), extend=True)


_FILL = [f"coalesce(a.{c}, b.{c})" for c in ("color", "elevation")] + [f"case when coalesce(a.{c}, 0) = 0 and b.{c} > 0 then b.{c} else a.{c} end" for c in ("angle", "elevated")]


@query("grid_fill_zero", f"with {OBS}, a as ({_A}), b as ({_B}) {_MERGE.format(*_FILL, join='full')}")
def grid_fill_zero(spark, sf_dir):
    return algebra.fill(*_sides(spark, sf_dir), extend=True, zero=("angle", "elevated"))


# Operators on one map take the cells of the whole observation table; each is registered under two names.
_ALL = f"{_CELLS} true group by gx, gy"


def _all(spark, sf_dir):
    return _cells(observations(spark, sf_dir))


_SQL = f"with {OBS}, c as ({_ALL}) select gx, gy, (select max(gy) from c) - gy as row, gx - (select min(gx) from c) as col, color from c"


@query("grid_matrix_index", _SQL)
@query("grid_matrix_index_all", _SQL)
def grid_matrix_index(spark, sf_dir):
    return algebra.matrix_index(_all(spark, sf_dir).select("gx", "gy", "color"))


_SQL = f"""with {OBS}, a as ({_ALL}), xs as (select unnest(range(-2, 67)) as gx), ys as (select unnest(range(-2, 67)) as gy)
    select xs.gx, ys.gy, a.color, a.elevation, a.angle, a.elevated from xs cross join ys left join a on a.gx = xs.gx and a.gy = ys.gy"""


@query("grid_extend_dense", _SQL)
@query("grid_extend_dense_all", _SQL)
def grid_extend_dense(spark, sf_dir):
    return algebra.dense(_all(spark, sf_dir), -2, -2, 66, 66)


_SQL = f"with {OBS}, a as ({_ALL}) select gx // 4 as gx, gy // 4 as gy, color, elevation, angle, elevated from a where gx % 4 = 0 and gy % 4 = 0"


@query("grid_resample_nearest", _SQL)
@query("grid_resample_nearest_all", _SQL)
def grid_resample_nearest(spark, sf_dir):
    return algebra.resample_nearest(_all(spark, sf_dir), 4)


_SQL = f"with {OBS}, a as ({_ALL}) select gx // 4 as gx, gy // 4 as gy, avg(cast(round(color * 100) as bigint)) as color, avg(cast(elevation as bigint)) as elevation from a group by all"


@query("grid_resample_area", _SQL)
@query("grid_resample_area_all", _SQL)
def grid_resample_area(spark, sf_dir):
    a = _all(spark, sf_dir).select("gx", "gy", F.round(F.col("color") * 100).cast("long").alias("color"), F.col("elevation").cast("long").alias("elevation"))
    return algebra.resample_area(a, 4)


_SQL = f"""with {OBS}, a as (select gx, gy, min(color) as color from obs group by gx, gy), d as (select unnest([-1, 0, 1]) as d),
    s as (select gx * 2 + i.d as gx, gy * 2 + j.d as gy, (1 - abs(i.d) / 2e0) * (1 - abs(j.d) / 2e0) as w, color from a, d i, d j)
    select gx, gy, round(sum(w * color), 4) as color from s group by gx, gy having sum(w) > 1 - 1e-9"""


@query("grid_refine_bilinear", _SQL)
@query("grid_refine_bilinear_all", _SQL)
def grid_refine_bilinear(spark, sf_dir):
    return algebra.refine_bilinear(_all(spark, sf_dir).select("gx", "gy", "color"), 2).withColumn("color", F.round("color", 4))


@query("validity_mask", f"with {OBS} select gx, gy, count(*) as n, count(elevation) as n_valid, count(*) filter (elevation between 10 and 40) as n_in_range from obs group by gx, gy")
def validity_mask(spark, sf_dir):
    e = F.col("elevation")
    return observations(spark, sf_dir).groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.count(e).alias("n_valid"), F.count_if(e.between(10, 40)).alias("n_in_range"))


@query("patch_missing", f"with {OBS} select gx, gy, cast(sum(cast(coalesce(elevation, 0) as bigint)) as bigint) as total from obs group by gx, gy")
def patch_missing(spark, sf_dir):
    patched = F.coalesce("elevation", F.lit(0.0)).cast("long")
    return observations(spark, sf_dir).groupBy("gx", "gy").agg(F.sum(patched).alias("total"))


@query(
    "clamp_after_resize",
    f"""with {OBS}, a as ({_CELLS} elevated = 0 group by gx, gy), b as ({_CELLS} elevated = 255 group by gx, gy)
    select gx, gy, case when elevation between (select min(elevation) from a) and (select max(elevation) from a) then elevation end as elevation from b""",
)
def clamp_after_resize(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return algebra.clamp_to(_cells(obs.where("elevated = 255")).select("gx", "gy", "elevation"), "elevation", _cells(obs.where("elevated = 0")))
