"""Queries of the spatial search, interpolation, plane fits and depth maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions.camera import Pinhole
from skylattice.operators import depth as D
from skylattice.operators import spatial
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import DEPTH, POINTS, depth_maps, points

#: Query positions: a lattice of 25 x 25 nodes.
_Q = "q as (select i * 25 + j as qid, i * 4.1e0 + 0.3e0 as qx, j * 4.1e0 + 0.3e0 as qy from (select unnest(range(25)) as i) cross join (select unnest(range(25)) as j))"
_D2 = "(x - qx) * (x - qx) + (y - qy) * (y - qy)"
CAMERA = Pinhole(60.0, 60.0, 25.0, 20.0, 50, 40)


def _queries(spark):
    i, j = F.floor(F.col("id") / 25), F.col("id") % 25
    return spark.range(625).select(F.col("id").alias("qid"), (i * 4.1 + 0.3).alias("qx"), (j * 4.1 + 0.3).alias("qy"))


def _places(p):
    """One point a place: the mean of those there."""
    return p.groupBy("x", "y").agg(F.min("z").alias("z"))


_PLACES = f"with {POINTS}, {_Q}, p as (select x, y, min(z) as z from points group by x, y)"


@query("knn2", f"{_PLACES} select qid, cast(rn as int) as rank, round(d2, 6) as d2, z from (select qid, d2, z, row_number() over (partition by qid order by d2, x, y) as rn from (select *, {_D2} as d2 from q, p)) where rn <= 2")
def knn2(spark, sf_dir):
    near = spatial.nearest(_queries(spark), _places(points(spark, sf_dir)), 2, 0.7, order=("x", "y"))
    return near.select("qid", "rank", F.round("d2", 6).alias("d2"), "z")


@query("radius_neighbors", f"{_PLACES} select qid, count(*) as n, round(sum(d2), 4) as total from (select qid, {_D2} as d2 from q, p) where d2 < 2.25 group by qid")
def radius_neighbors(spark, sf_dir):
    pairs = spatial.radius_join(_queries(spark), _places(points(spark, sf_dir)), 1.5)
    return pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 4).alias("total"))


@query("k_furthest", f"{_PLACES} select qid, cast(rn as int) as rank, round(d2, 6) as d2 from (select qid, d2, row_number() over (partition by qid order by d2 desc, x, y) as rn from (select *, {_D2} as d2 from q, p) where d2 < 2.25) where rn <= 3")
def k_furthest(spark, sf_dir):
    pairs = spatial.radius_join(_queries(spark), _places(points(spark, sf_dir)), 1.5)
    return spatial.furthest(pairs, 3, order=("x", "y")).select("qid", "rank", F.round("d2", 6).alias("d2"))


def _idw_sql(values, exact):
    sums = ", ".join(f"sum({v} / nullif(d2, 0)) as s_{v}, avg({v}) filter (d2 = 0) as h_{v}" for v in values)
    return f"""with {POINTS}, q as (select i as gx, j as gy, i * 2e0 as qx, j * 2e0 as qy from (select unnest(range(50)) as i) cross join (select unnest(range(50)) as j)),
    p as (select x, y, z, nx, ny, nz from points), n as (select gx, gy, {_D2} as d2, z, nx, ny, nz from q, p where {_D2} < 10),
    ring as (select gx, gy, ring from (select gx, gy, floor(d2 / 2) + 1 as ring, row_number() over (partition by gx, gy order by d2) as rn from n) where rn = 3 and ring < 6),
    s as (select gx, gy, sum(1 / nullif(d2, 0)) as w, {sums} from n join ring using (gx, gy) where d2 < ring * 2 group by gx, gy) {exact}"""


@query("idw_elevation", _idw_sql(["z"], "select gx, gy, round(coalesce(h_z, s_z / w), 4) as elevation from s"))
def idw_elevation(spark, sf_dir):
    return spatial.idw_surface(points(spark, sf_dir), 2.0, 6, (0, 0, 49, 49)).select("gx", "gy", F.round("z", 4).alias("elevation"))


_NORM = "sqrt(power(coalesce(h_nx, s_nx / w), 2) + power(coalesce(h_ny, s_ny / w), 2) + power(coalesce(h_nz, s_nz / w), 2))"


@query("idw_normal", _idw_sql(["nx", "ny", "nz"], "select gx, gy, " + ", ".join(f"round(coalesce(h_{c}, s_{c} / w) / {_NORM}, 5) as {c}" for c in ("nx", "ny", "nz")) + " from s"))
def idw_normal(spark, sf_dir):
    mean = spatial.idw_surface(points(spark, sf_dir), 2.0, 6, (0, 0, 49, 49), ("nx", "ny", "nz"))
    return spatial.normalised(mean, "nx", "ny", "nz").select("gx", "gy", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


@query("cloud_gsd")
def cloud_gsd(spark, sf_dir):
    return spatial.ground_sampling_distance(points(spark, sf_dir), 100)


def _corner(k):
    return tuple(F.col("p")[k][c] for c in ("x", "y", "z"))


@query(
    "plane_exact",
    f"""{_PLACES}, n as (select qid, x, y, z, row_number() over (partition by qid order by d2, x, y) as rn from (select *, {_D2} as d2 from q, p)),
    t as (select qid, max(x) filter (rn = 1) ax, max(y) filter (rn = 1) ay, max(z) filter (rn = 1) az, max(x) filter (rn = 2) bx, max(y) filter (rn = 2) by_, max(z) filter (rn = 2) bz,
      max(x) filter (rn = 3) cx, max(y) filter (rn = 3) cy, max(z) filter (rn = 3) cz from n where rn <= 3 group by qid),
    c as (select qid, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) as x, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) as y, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) as z from t)
    select qid, round(case when z < 0 then -x else x end / nullif(sqrt(x*x + y*y + z*z), 0), 4) as nx, round(case when z < 0 then -y else y end / nullif(sqrt(x*x + y*y + z*z), 0), 4) as ny,
      round(abs(z) / nullif(sqrt(x*x + y*y + z*z), 0), 4) as nz from c where abs(z) > 1e-9""",
)
def plane_exact(spark, sf_dir):
    near = spatial.nearest(_queries(spark), _places(points(spark, sf_dir)), 3, 1.5, order=("x", "y"))
    three = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "z"))).alias("p"))
    a, b, c = (_corner(k) for k in range(3))
    cross = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return three.where(F.abs(cross) > 1e-9).select("qid", *[F.round(n, 4).alias(x) for n, x in zip(spatial.plane_of_three(a, b, c), ("nx", "ny", "nz"), strict=True)])


@query(
    "plane_cov",
    f"""with {POINTS} select cast(floor(x / 10) as bigint) as bx, cast(floor(y / 10) as bigint) as by, count(*) as n, round(avg(z), 4) as mz, round(covar_pop(x, z), 4) as cxz, round(covar_pop(y, z), 4) as cyz,
    round(covar_pop(x, y), 4) as cxy, round(var_pop(z), 3) as czz from points group by all""",
)
def plane_cov(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"bx": F.floor(F.col("x") / 10), "by": F.floor(F.col("y") / 10)})
    m = spatial.plane_moments(p, "bx", "by")
    return m.select("bx", "by", "n", *[F.round(c, 4).alias(c) for c in ("mz", "cxz", "cyz", "cxy")], F.round("czz", 3).alias("czz"))


@query("plane_fit")
def plane_fit(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"bx": F.floor(F.col("x") / 10), "by": F.floor(F.col("y") / 10)})
    return spatial.fit_planes(spatial.plane_moments(p, "bx", "by")).select("bx", "by", "n", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")])


def _depth_cells(spark, sf_dir):
    return depth_maps(spark, sf_dir).where("depth is not null").select("frame_id", F.col("c").alias("gx"), F.col("r").alias("gy"), F.col("depth").alias("v"))


_MEDIAN = f"""with {DEPTH}, a as (select frame_id, c as gx, r as gy, depth as v from depth where depth is not null), d as (select unnest(range(-2, 3)) as d),
    s as (select frame_id, gx + i.d as gx, gy + j.d as gy, v from a, d i, d j) select a.frame_id, a.gx, a.gy, median(s.v) as v from a join s using (frame_id, gx, gy) group by a.frame_id, a.gx, a.gy"""


@query("smooth_median", _MEDIAN)
@query("smooth_median_frames", _MEDIAN)
def smooth_median(spark, sf_dir):
    return spatial.smooth(_depth_cells(spark, sf_dir), "v", by=("frame_id",))


_BILATERAL = f"""with {DEPTH}, a as (select frame_id, c as gx, r as gy, depth as v from depth where depth is not null), d as (select unnest(range(-2, 3)) as d),
    s as (select frame_id, gx + i.d as gx, gy + j.d as gy, i.d as dx, j.d as dy, v from a, d i, d j where i.d * i.d + j.d * j.d <= 4),
    w as (select a.frame_id, a.gx, a.gy, s.v, exp(-(dx * dx + dy * dy) / 1250e0 - (s.v - a.v) * (s.v - a.v) / 1250e0) as w from a join s using (frame_id, gx, gy))
    select frame_id, gx, gy, round(sum(w * v) / sum(w), 4) as v from w group by frame_id, gx, gy"""


@query("smooth_bilateral", _BILATERAL)
@query("smooth_bilateral_frames", _BILATERAL)
def smooth_bilateral(spark, sf_dir):
    return spatial.smooth(_depth_cells(spark, sf_dir), "v", kind="bilateral", by=("frame_id",)).withColumn("v", F.round("v", 4))


@query("depth_stats", f"""with {DEPTH}, a as (select frame_id, depth, coalesce(depth, -1) as d from depth),
    k as (select frame_id, d, row_number() over (partition by frame_id order by d) - 1 as rn, count(*) over (partition by frame_id) as n from a)
    select frame_id, (select count(*) from a where a.frame_id = k.frame_id) as n, (select min(depth) from a where a.frame_id = k.frame_id) as min_depth,
      (select max(depth) from a where a.frame_id = k.frame_id) as max_depth, d as median_depth from k where rn = n // 2""")
def depth_stats(spark, sf_dir):
    return D.stats(depth_maps(spark, sf_dir))


@query("depth_clamp", f"""with {DEPTH}, m as (select frame_id, quantile_disc(depth, 0.5) as m from depth where depth > 0 group by frame_id)
    select frame_id, r, c, case when depth between 0.9 * m and 1.1 * m then depth end as depth from depth left join m using (frame_id)""")
def depth_clamp(spark, sf_dir):
    return D.clamp(depth_maps(spark, sf_dir), 0.9, 1.1)


@query("reproject_depth", f"with {DEPTH} select frame_id, r, c, round((c - 25e0) / 60e0 * depth, 6) as x, round((r - 20e0) / 60e0 * depth, 6) as y, depth as z from depth where depth > 0")
def reproject_depth(spark, sf_dir):
    return D.reproject(depth_maps(spark, sf_dir), CAMERA).select("frame_id", "r", "c", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


@query("depth_from_cloud", f"""with {POINTS}, p as (select floor(60e0 * (x - 50) / (z + 60) + 25e0) as c, floor(60e0 * (y - 50) / (z + 60) + 20e0) as r, z + 60 as z, point_id from points)
    select cast(r as int) as r, cast(c as int) as c, arg_max(z, point_id) as depth from p where c between 0 and 49 and r between 0 and 39 group by r, c""")
def depth_from_cloud(spark, sf_dir):
    p = points(spark, sf_dir).select("point_id", (F.col("x") - 50).alias("x"), (F.col("y") - 50).alias("y"), (F.col("z") + 60).alias("z"))
    return D.from_points(p, CAMERA)


@query("depth_normals", f"""with {DEPTH}, n as (select a.frame_id, a.r, a.c, (e.depth - w.depth) / 2 as dx, (s.depth - n.depth) / 2 as dy from depth a
      join depth w on w.frame_id = a.frame_id and w.r = a.r and w.c = a.c - 1 join depth e on e.frame_id = a.frame_id and e.r = a.r and e.c = a.c + 1
      join depth n on n.frame_id = a.frame_id and n.c = a.c and n.r = a.r - 1 join depth s on s.frame_id = a.frame_id and s.c = a.c and s.r = a.r + 1
      where a.depth is not null and w.depth is not null and e.depth is not null and n.depth is not null and s.depth is not null)
    select frame_id, unnest(case r when 1 then [1, 0] when 38 then [38, 39] else [r] end) as r, c, nx, ny, nz from (
      select frame_id, r, unnest(case c when 1 then [1, 0] when 48 then [48, 49] else [c] end) as c, round(-dx / sqrt(dx * dx + dy * dy + 1), 6) as nx, round(-dy / sqrt(dx * dx + dy * dy + 1), 6) as ny, round(1 / sqrt(dx * dx + dy * dy + 1), 6) as nz from n)""")
def depth_normals(spark, sf_dir):
    return D.normals(depth_maps(spark, sf_dir), (40, 50)).select("frame_id", "r", "c", *[F.round(x, 6).alias(x) for x in ("nx", "ny", "nz")])


_VOTES = f"""with {DEPTH}, v as (select a.frame_id, a.r, a.c, a.depth, cast(coalesce(sum(case when abs(b.depth - a.depth) / a.depth < 0.1 then 1 else 0 end), 0) as bigint) as n_votes
    from depth a left join depth b on b.r = a.r and b.c = a.c and b.frame_id <> a.frame_id and b.frame_id between a.frame_id - 2 and a.frame_id + 1 and b.depth > 0
    where a.depth > 0 group by all)"""


@query("consistency_votes", f"{_VOTES} select *, n_votes >= 2 as kept from v")
def consistency_votes(spark, sf_dir):
    return D.votes(depth_maps(spark, sf_dir))


@query("coverage", f"{_VOTES} select frame_id, round(100 * avg(case when n_votes >= 2 then 1e0 else 0e0 end), 6) as coverage, 100 * avg(case when n_votes >= 2 then 1e0 else 0e0 end) >= 30 as stays from v group by frame_id")
def coverage(spark, sf_dir):
    return D.coverage(D.votes(depth_maps(spark, sf_dir))).withColumn("coverage", F.round("coverage", 6))


@query("scene_depth", f"with {POINTS}, d as (select cast(floor(x) as bigint) as bx, 0.1e0 * x - 0.2e0 * y - 0.9e0 * z + 150e0 as d from points) select bx, round(min(d), 6) as min_depth, round(quantile_disc(d, 0.5), 6) as median_depth, round(max(d), 6) as max_depth from d group by bx")
def scene_depth(spark, sf_dir):
    got = D.scene_depth(points(spark, sf_dir).withColumn("bx", F.floor("x")), (0.1, -0.2, -0.9), 150.0, "bx")
    return got.select("bx", *[F.round(c, 6).alias(c) for c in ("min_depth", "median_depth", "max_depth")])


@query("plane_offset", f"with {POINTS} select cast(floor(x) as bigint) as bx, quantile_disc(z, 0.5) as median from points group by all")
def plane_offset(spark, sf_dir):
    return D.lower_median(points(spark, sf_dir).withColumn("bx", F.floor("x")), "z", "bx")
