"""Queries of dense rasters: sizes, lenses, rectified pairs and warping. Their tables grow with orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.camera import Pinhole, heading_rotation
from skylattice.operators import blocks as B
from skylattice.operators import delaunay, imaging, quadtree
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import table
from skylattice.sources import geotiff

#: Columns of a map that gets longer with the table; pixels of a frame.
WIDE, LENS = 101, Pinhole(30.0, 30.0, 15.5, 11.5, 32, 24, -0.12, 0.03, 0.001, -0.0007)
PIXELS = LENS.width * LENS.height
FLAT = Pinhole(30.0, 30.0, 15.5, 11.5, 32, 24)


def raster(spark, sf_dir):
    """gx, gy, elevation (with holes) and color of a map of WIDE columns."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k % WIDE).alias("gx"), F.floor(k / WIDE).alias("gy"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_totalprice") / 1000).alias("elevation"), (F.col("o_custkey") % 256).cast("double").alias("color"),
    )


RASTER = f"""raster as materialized (select o_orderkey % {WIDE} as gx, o_orderkey // {WIDE} as gy, case when o_custkey % 11 <> 0 then o_totalprice / 1000e0 end as elevation, cast(o_custkey % 256 as double) as color from orders),
  ext as materialized (select {WIDE} as w, max(gy) + 1 as h from raster)"""


def photos(spark, sf_dir):
    """Pixels frame_id, gx, gy, color of frames as LENS takes them; the last one is not full."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.floor(k / PIXELS).alias("frame_id"), (k % LENS.width).alias("gx"), F.floor(k % PIXELS / LENS.width).alias("gy"), F.col("o_totalprice").alias("color"))


PHOTOS = f"photos as materialized (select o_orderkey // {PIXELS} as frame_id, o_orderkey % {LENS.width} as gx, o_orderkey % {PIXELS} // {LENS.width} as gy, o_totalprice as color from orders)"

_BILINEAR = ["1 - f", "f"]
_A = B.CUBIC
_FAR, _NEAR = (lambda d: f"(({_A}e0 * {d} - {5 * _A}e0) * {d} + {8 * _A}e0) * {d} - {4 * _A}e0"), (lambda d: f"({_A + 2}e0 * {d} - {_A + 3}e0) * {d} * {d} + 1")
_CUBIC = [_FAR("(1 + f)"), _NEAR("f"), _NEAR("(1 - f)"), _FAR("(2 - f)")]


def _weights(kernel: list[str], f: str) -> str:
    return "case t.d " + " ".join(f"when {k} then {w.replace('f', f)}" for k, w in enumerate(kernel)) + " end"


def _taps(places: str, keys: str, source: str, layers: list[str], kernel: list[str], clamp: str | None = None, join: str = "") -> str:
    """SQL: layers at the places (keys, u, v) of a source table; a place is empty if a tap is. clamp: SQL of a tap's cell from its name and the number of cells."""
    first = -1 if len(kernel) == 4 else 0
    cell = lambda c, n: (clamp or "{c}").format(c=c, n=n)
    sums = ", ".join(f"case when count(*) filter (wt <> 0 and s.{x} is null) = 0 then sum(wt * s.{x}) filter (wt <> 0) end as {x}" for x in layers)
    return f"""(with x as (select {keys}, u, v, t.d + cast(floor(u) as bigint) + {first} as sx, {_weights(kernel, "(u - floor(u))")} as wx from {places}, (select unnest(range({len(kernel)})) as d) t),
      xy as (select x.*, t.d + cast(floor(v) as bigint) + {first} as sy, wx * ({_weights(kernel, "(v - floor(v))")}) as wt from x, (select unnest(range({len(kernel)})) as d) t)
      select {keys}, {sums} from (select xy.*, {cell("sx", "w")} as cx, {cell("sy", "h")} as cy from xy{", ext" if clamp else ""}) q left join {source} s on s.gx = q.cx and s.gy = q.cy {join} group by {keys})"""


def _rounded(df, *layers):
    return df.select(*[c for c in df.columns if c not in layers], *[F.round(c, 4).alias(c) for c in layers])


_EDGE = "greatest(0, least({n} - 1, {c}))"


@query(
    "resample_cubic",
    f"""with {RASTER}, p as (select x, y, (x + 0.5e0) * (w / (2e0 * w - 1)) - 0.5e0 as u, (y + 0.5e0) * (h / (2e0 * h - 1)) - 0.5e0 as v from ext, (select unnest(range({2 * WIDE - 1})) as x), (select unnest(range((select 2 * h - 1 from ext))) as y))
    select x as gx, y as gy, round(elevation, 4) as elevation, round(color, 4) as color from {_taps("p", "x, y", "raster", ["elevation", "color"], _CUBIC, _EDGE)} where elevation is not null or color is not null""",
)
def resample_cubic(spark, sf_dir):
    cells = raster(spark, sf_dir)
    source = B.extent_of(cells)
    target = source.resized(2 * source.width - 1, 2 * source.height - 1)
    got = B.changed_size(B.to_blocks(cells, ["elevation", "color"]), ["elevation", "color"], source, target, "cubic")
    return _rounded(B.to_cells(got, ["elevation", "color"]), "elevation", "color")


_AXIS = "(select i as {o}, unnest(range(cast(floor(i * k) as bigint), least(cast(ceil((i + 1) * k) as bigint), n))) as {s}, k from (select unnest(range(m)) as i, n * 1e0 / m as k, n from (select {n} as n, cast(floor(({n} - 1) * 0.4e0 + 0.5e0) as bigint) + 1 as m from ext)))"
_SHARE = "(least({s} + 1, ({o} + 1) * {k}) - greatest({s}, {o} * {k}))"


@query(
    "resample_area_size",
    f"""with {RASTER}, ax as (select o, s, {_SHARE.format(s="s", o="o", k="k")} as share from {_AXIS.format(o="o", s="s", n="w")}), ay as (select o, s, {_SHARE.format(s="s", o="o", k="k")} as share from {_AXIS.format(o="o", s="s", n="h")})
    select ax.o as gx, ay.o as gy, round(sum(ax.share * ay.share * elevation) / sum(ax.share * ay.share) filter (elevation is not null), 4) as elevation, round(sum(ax.share * ay.share * color) / sum(ax.share * ay.share) filter (color is not null), 4) as color
    from raster join ax on ax.s = gx join ay on ay.s = gy where ax.share > 1e-12 and ay.share > 1e-12 group by all""",
)
def resample_area_size(spark, sf_dir):
    cells = raster(spark, sf_dir)
    source = B.extent_of(cells)
    less = lambda n: math.floor((n - 1) * 0.4 + 0.5) + 1
    got = B.changed_size(B.to_blocks(cells, ["elevation", "color"]), ["elevation", "color"], source, B.Extent(0, 0, less(source.width), less(source.height)), "area")
    return _rounded(B.to_cells(got, ["elevation", "color"]), "elevation", "color")


def _lens_sql(u: str, v: str) -> tuple[str, str]:
    """SQL of where LENS shows an ideal pixel."""
    c = LENS
    x, y = f"(({u} - {c.cx}e0) / {c.fx}e0)", f"(({v} - {c.cy}e0) / {c.fy}e0)"
    r2 = f"({x} * {x} + {y} * {y})"
    radial = f"(1 + {r2} * ({c.k1}e0 + {r2} * ({c.k2}e0 + {r2} * {c.k3}e0)))"
    return (
        f"({x} * {radial} + 2 * {c.p1}e0 * {x} * {y} + {c.p2}e0 * ({r2} + 2 * {x} * {x})) * {c.fx}e0 + {c.cx}e0",
        f"({y} * {radial} + {c.p1}e0 * ({r2} + 2 * {y} * {y}) + 2 * {c.p2}e0 * {x} * {y}) * {c.fy}e0 + {c.cy}e0",
    )


_U, _V = _lens_sql("x", "y")
_FRAME_JOIN = "and s.frame_id = q.frame_id"


@query(
    "undistort_images",
    f"""with {PHOTOS}, p as (select frame_id, x, y, {_U} as u, {_V} as v from (select distinct frame_id from photos), (select unnest(range({LENS.width})) as x), (select unnest(range({LENS.height})) as y))
    select frame_id, x as gx, y as gy, round(color, 4) as color from {_taps("p", "frame_id, x, y".replace("frame_id", "q.frame_id"), "photos", ["color"], _BILINEAR, None, _FRAME_JOIN).replace("select q.frame_id, x, y, u", "select frame_id, x, y, u")} where color is not null""",
)
def undistort_images(spark, sf_dir):
    images = B.to_blocks(photos(spark, sf_dir), ["color"], imaging.FRAME)
    return _rounded(B.to_cells(imaging.undistorted_images(images, ["color"], LENS), ["color"], imaging.FRAME), "color")


def _pairs(spark, sf_dir):
    """Pairs of successive frames of the photos, with poses."""
    i = F.col("frame_id")
    poses = photos(spark, sf_dir).select("frame_id").distinct().withColumns({"x": 5.0 * i, "y": 2.0 * (i % 3), "z": 50 + 0.3 * (i % 2), "heading": 4.0 * i})
    turn = heading_rotation(F.col("heading"))
    posed = poses.select("frame_id", F.struct("x", "y", "z", *[turn[a][b].alias(f"r{a}{b}") for a in range(3) for b in range(3)]).alias("pose"))
    left = posed.where(i % 2 == 0).select(i.alias("left_id"), F.col("pose").alias("left"))
    right = posed.where(i % 2 == 1).select(i.alias("right_id"), F.col("pose").alias("right"))
    return left.join(right, F.col("right_id") == F.col("left_id") + 1).withColumn("pair_id", F.floor(F.col("left_id") / 2))


_POSE = "select frame_id, 5e0 * frame_id as px, 2e0 * (frame_id % 3) as py, 50 + 0.3e0 * (frame_id % 2) as pz, cos(radians(-4e0 * frame_id)) as c, sin(radians(-4e0 * frame_id)) as s from (select distinct frame_id from photos)"
# Both cameras look straight down, so the mean axis is (0, 0, -1), a rotation has the rows (c s 0), (s -c 0), (0 0 -1), and the view's y axis is the mean axis times the baseline.
_RECTIFIED = f"""pose as materialized ({_POSE}), way as (select l.frame_id // 2 as pair_id, r.px - l.px as bx, r.py - l.py as by_, r.pz - l.pz as bz from pose l join pose r on r.frame_id = l.frame_id + 1 where l.frame_id % 2 = 0),
    unit as (select pair_id, bx / n as ax, by_ / n as ay, bz / n as az, by_ / m as ex, -bx / m as ey, n as baseline from (select *, sqrt(bx * bx + by_ * by_ + bz * bz) as n, sqrt(bx * bx + by_ * by_) as m from way)),
    axes as (select *, ay * 0 - az * ey as kx, az * ex - ax * 0 as ky, ax * ey - ay * ex as kz from unit),
    turns as materialized (select pair_id, frame_id, frame_id % 2 as side, baseline, c * ax + s * ay as t0, c * ex + s * ey as t1, c * kx + s * ky as t2, s * ax - c * ay as t3, s * ex - c * ey as t4, s * kx - c * ky as t5, -az as t6, 0e0 as t7, -kz as t8
      from axes join pose on frame_id // 2 = pair_id)"""


@query(
    "stereo_rectification",
    f"with {PHOTOS}, {_RECTIFIED} select pair_id, side, round(baseline, 6) as baseline, {', '.join(f'round(t{k}, 6) + 0 as t{k}' for k in range(9))} from turns",
)
def stereo_rectification(spark, sf_dir):
    got = imaging.rectification(_pairs(spark, sf_dir), LENS)
    side = lambda n, s: got.select("pair_id", F.lit(n).cast("long").alias("side"), F.round("baseline", 6).alias("baseline"), *[(F.round(F.col(f"{s}_turn")[k], 6) + 0).alias(f"t{k}") for k in range(9)])
    return side(0, "left").unionByName(side(1, "right"))


_RU, _RV = _lens_sql(f"({LENS.fx}e0 * mx / mz + {LENS.cx}e0)", f"({LENS.fy}e0 * my / mz + {LENS.cy}e0)")
_RX, _RY = f"((x - {LENS.cx}e0) / {LENS.fx}e0)", f"((y - {LENS.cy}e0) / {LENS.fx}e0)"


@query(
    "stereo_remap",
    f"""with {PHOTOS}, {_RECTIFIED}, r as (select pair_id, side, frame_id, x, y, t0 * {_RX} + t1 * {_RY} + t2 as mx, t3 * {_RX} + t4 * {_RY} + t5 as my, t6 * {_RX} + t7 * {_RY} + t8 as mz
      from turns, (select unnest(range({LENS.width})) as x), (select unnest(range({LENS.height})) as y)),
    p as (select pair_id, side, frame_id, x, y, {_RU} as u, {_RV} as v from r where mz > 1e-9)
    select pair_id, cast(side as integer) as side, frame_id, x as gx, y as gy, round(color, 4) as color from {_taps("p", "pair_id, side, q.frame_id, x, y", "photos", ["color"], _BILINEAR, None, _FRAME_JOIN).replace("select pair_id, side, q.frame_id, x, y, u", "select pair_id, side, frame_id, x, y, u")} where color is not null""",
)
def stereo_remap(spark, sf_dir):
    images = B.to_blocks(photos(spark, sf_dir), ["color"], imaging.FRAME)
    got = imaging.remapped_pairs(images, ["color"], imaging.rectification(_pairs(spark, sf_dir), LENS), LENS)
    return _rounded(B.to_cells(got, ["color"], ("pair_id", "side", "frame_id")), "color")


#: A corner of the warped map in cells of RES metres, its UTM zone, and metres of the lattice it goes to.
CORNER_X, CORNER_Y, RES, ZONE, OUT = 60400, 579200, 10.0, 32, 12.5
_AT = f"mx / {geo.AXIS}e0"
_LATLON = f"degrees(2 * atan(exp(my / {geo.AXIS}e0)) - pi() / 2) as plat, degrees({_AT}) as plon"
_OUTLINE = f"select i / {imaging.OUTLINE - 1}e0 as a from (select unnest(range({imaging.OUTLINE})) as i)"
_MERCATOR = geo.sql_steps("select x * 10e0 as ee, y * 10e0 as nn from outline", geo.utm_inverse("ee", "nn", str(ZONE)))


@query(
    "warp_bilinear",
    f"""with {RASTER}, box as (select {CORNER_X} as x0, {CORNER_Y} as y0, {CORNER_X} + w - 1 as x1, {CORNER_Y} + h - 1 as y1 from ext),
    outline as (select x0 + (x1 - x0) * a as x, y0 as y from box, ({_OUTLINE}) union all select x0 + (x1 - x0) * a, y1 from box, ({_OUTLINE}) union all select x0, y0 + (y1 - y0) * a from box, ({_OUTLINE}) union all select x1, y0 + (y1 - y0) * a from box, ({_OUTLINE})),
    merc as (select radians(longitude) * {geo.AXIS}e0 as mx, {geo.AXIS}e0 * ln(tan(pi() / 4 + radians(latitude) / 2)) as my from ({_MERCATOR})),
    lim as (select cast(floor(min(mx) / {OUT}e0) as bigint) as x0, cast(ceil(max(mx) / {OUT}e0) as bigint) as x1, cast(floor(min(my) / {OUT}e0) as bigint) as y0, cast(ceil(max(my) / {OUT}e0) as bigint) as y1 from merc),
    nodes as (select wx, wy, wx * {OUT}e0 as mx, wy * {OUT}e0 as my from (select unnest(range((select x0 from lim), (select x1 + 1 from lim))) as wx), (select unnest(range((select y0 from lim), (select y1 + 1 from lim))) as wy)),
    p as materialized (select wx, wy, easting / {RES}e0 - {CORNER_X} as u, northing / {RES}e0 - {CORNER_Y} as v from ({geo.sql_steps(f"select wx, wy, {_LATLON} from nodes", geo.utm_forward("plat", "plon", str(ZONE)))})),
    taps as (select wx, wy, cast(floor(u) as bigint) + dx as cx, cast(floor(v) as bigint) + dy as cy, (case dx when 1 then u - floor(u) else 1 - (u - floor(u)) end) * (case dy when 1 then v - floor(v) else 1 - (v - floor(v)) end) as w,
      dx = cast(floor(u - floor(u) + 0.5) as bigint) and dy = cast(floor(v - floor(v) + 0.5) as bigint) as own from p, (select unnest(range(2)) as dx), (select unnest(range(2)) as dy)),
    got as (select wx, wy, {', '.join(f"case when bool_or(own and s.{c} is not null) then sum(w * s.{c}) / sum(w) filter (s.{c} is not null) end as {c}" for c in ("elevation", "color"))} from taps join raster s on s.gx = cx and s.gy = cy group by wx, wy)
    select wx as gx, wy as gy, round(elevation / 512, 3) as elevation, round(color / 512, 3) as color from got where elevation is not null or color is not null""",
)
def warp_bilinear(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumns({"gx": F.col("gx") + CORNER_X, "gy": F.col("gy") + CORNER_Y})
    layers = ["elevation", "color"]
    got, _, _ = imaging.warped(B.to_blocks(cells, layers), layers, B.extent_of(cells), RES, ZONE, OUT)
    return B.to_cells(got, layers).select("gx", "gy", *[F.round(F.col(c) / 512, 3).alias(c) for c in layers])


def _valid(spark, sf_dir):
    return raster(spark, sf_dir).where("elevation is not null")


@query(
    "delaunay_counts",
    f"""with {RASTER}, p as materialized (select gx, gy from raster where elevation is not null), col as materialized (select gx, min(gy) as lo, max(gy) as hi from p group by gx),
    low as (select gx, lo as gy from col c where not exists (select 1 from col l, col r where l.gx < c.gx and r.gx > c.gx and (c.lo - l.lo) * (r.gx - l.gx) > (r.lo - l.lo) * (c.gx - l.gx))),
    top as (select gx, hi as gy from col c where not exists (select 1 from col l, col r where l.gx < c.gx and r.gx > c.gx and (c.hi - l.hi) * (r.gx - l.gx) < (r.hi - l.hi) * (c.gx - l.gx))),
    hull as (select * from low union select * from top union select gx, gy from p where gx in (select min(gx) from p union all select max(gx) from p)),
    area as (select (select sum((nx - gx) * (gy + ny)) from (select gx, gy, lead(gx) over (order by gx) as nx, lead(gy) over (order by gx) as ny from top)) -
      (select sum((nx - gx) * (gy + ny)) from (select gx, gy, lead(gx) over (order by gx) as nx, lead(gy) over (order by gx) as ny from low)) as area2)
    select cast(2 * (select count(*) from p) - (select count(*) from hull) - 2 as bigint) as n_triangles, cast(area2 as bigint) as area2, (select count(*) from hull) as n_hull from area""",
)
def delaunay_counts(spark, sf_dir):
    return delaunay.counted(delaunay.delaunay(_valid(spark, sf_dir)))


@query("delaunay_mesh")
def delaunay_mesh(spark, sf_dir):
    cells = _valid(spark, sf_dir)
    return delaunay.raised(delaunay.delaunay(cells), cells, "elevation")


def scattered(spark, sf_dir):
    """pid, x and y of points of which a third lie in one small place."""
    k, x, y = F.col("o_orderkey"), F.col("o_totalprice") / 1000, (F.col("o_custkey") * 37 % 1000) / 2.0
    tight = k % 3 == 0
    return table(spark, sf_dir, "orders").select(k.alias("pid"), F.when(tight, 250 + x / 500).otherwise(x).alias("x"), F.when(tight, 250 + y / 500).otherwise(y).alias("y"))


_SCATTERED = """pts as materialized (select o_orderkey as pid, case when o_orderkey % 3 = 0 then 250 + o_totalprice / 1000e0 / 500 else o_totalprice / 1000e0 end as x,
  case when o_orderkey % 3 = 0 then 250 + (o_custkey * 37 % 1000) / 2e0 / 500 else (o_custkey * 37 % 1000) / 2e0 end as y from orders)"""


@query(
    "knn_of_rows",
    f"""with {_SCATTERED}, d as (select q.pid as qid, p.pid, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) as d2 from pts q, pts p where q.pid % 20 = 0)
    select qid, pid, cast(rank as integer) as rank, round(d2, 6) as d2 from (select *, row_number() over (partition by qid order by d2, pid) as rank from d) where rank <= 5""",
)
def knn_of_rows(spark, sf_dir):
    p = scattered(spark, sf_dir)
    asked = p.where("pid % 20 = 0").select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return quadtree.Quadtree(p).nearest(asked, 5, ("pid",)).select("qid", "pid", "rank", F.round("d2", 6).alias("d2"))


def _sites(spark, sf_dir):
    """One point a customer, most of them near others."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), ((k * 37 % 211) + F.col("c_acctbal") / 10000).alias("x"), ((k * 101 % 97) + F.col("c_acctbal") % 1000 / 300).alias("y"))


@query(
    "cloud_without_outliers",
    """with pts as materialized (select c_custkey as pid, (c_custkey * 37 % 211) + c_acctbal / 10000e0 as x, (c_custkey * 101 % 97) + c_acctbal % 1000 / 300e0 as y from customer),
    d as (select q.pid, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d from pts q, pts p), n as (select pid, d, row_number() over (partition by pid order by d) as rn from d),
    m as (select pid, avg(d) as apart from n where rn between 2 and 7 group by pid) select pid, round(apart, 6) as apart from m where apart <= (select avg(apart) + stddev_samp(apart) from m)""",
)
def cloud_without_outliers(spark, sf_dir):
    return quadtree.without_outliers(_sites(spark, sf_dir), "pid").select("pid", F.round("apart", 6).alias("apart"))


def _tiffs(spark, sf_dir):
    return geotiff.geotiffs(B.to_blocks(raster(spark, sf_dir), ["elevation"]), ["elevation"], RES, 32632, side=256)


@query("geotiff_cells", f"with {RASTER} select gx, gy, round(cast(cast(elevation as float) as double), 3) as elevation from raster where elevation is not null")
def geotiff_cells(spark, sf_dir):
    got = B.to_cells(geotiff.read_blocks(_tiffs(spark, sf_dir), ["elevation"]), ["elevation"])
    return got.select("gx", "gy", F.round("elevation", 3).alias("elevation"))


@query(
    "geotiff_overviews",
    f"""with {RASTER}, far as (select gx * 7 as gx, gy * 7 as gy, elevation from raster where elevation is not null)
    select k as level, gx, gy, round(cast(cast(elevation as float) as double), 3) as elevation from far, (select unnest(range(1, 3)) as k) where gx % (1 << k) = 0 and (gy + 1) % (1 << k) = 0""",
)
def geotiff_overviews(spark, sf_dir):
    far = raster(spark, sf_dir).withColumns({"gx": F.col("gx") * 7, "gy": F.col("gy") * 7})
    files = geotiff.geotiffs(B.to_blocks(far, ["elevation"]), ["elevation"], RES, 32632, side=1024)
    each = [geotiff.read_cells(files, ["elevation"], k).select(F.lit(k).cast("long").alias("level"), "gx", "gy", F.round("elevation", 3).alias("elevation")) for k in (1, 2)]
    return each[0].unionByName(each[1])
