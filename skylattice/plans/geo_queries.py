"""Queries of geographic transforms and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import tiles
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import FRAMES, GEO, POINTS, frames, points, positions

_ZONE, _BAND = geo.utm_zone("latitude", "longitude"), geo.utm_band("latitude")
_FORWARD = geo.utm_forward("latitude", "longitude", "zone")


@query("utm_zone_band", f"with {GEO} select id, {_ZONE} as zone, {_BAND} as band from geo")
def utm_zone_band(spark, sf_dir):
    return positions(spark, sf_dir).select("id", F.expr(_ZONE).alias("zone"), F.expr(_BAND).alias("band"))


_UTM_SQL = geo.sql_steps(f"select *, {_ZONE} as zone from geo", _FORWARD)


@query("wgs_to_utm", f"with {GEO} select id, zone, round(easting, 3) as easting, round(northing, 3) as northing from ({_UTM_SQL})")
def wgs_to_utm(spark, sf_dir):
    utm = geo.with_steps(positions(spark, sf_dir).withColumn("zone", F.expr(_ZONE)), _FORWARD)
    return utm.select("id", "zone", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


_INVERSE = geo.utm_inverse("easting", "northing", "32")
_WGS_SQL = geo.sql_steps("select frame_id, easting, northing from frames", _INVERSE)


@query("utm_to_wgs", f"with {FRAMES} select frame_id, round(latitude, 8) as latitude, round(longitude, 8) as longitude from ({_WGS_SQL})")
def utm_to_wgs(spark, sf_dir):
    wgs = geo.with_steps(frames(spark, sf_dir).select("frame_id", "easting", "northing"), _INVERSE)
    return wgs.select("frame_id", F.round("latitude", 8).alias("latitude"), F.round("longitude", 8).alias("longitude"))


@query("dms_format", f"""with {GEO}, a as (select id, abs(latitude) as a, latitude < 0 as s from geo), d as (select *, cast(floor(a + 1e-9) as bigint) as d from a), m as (select *, cast(floor((a - d) * 60 + 1e-7) as bigint) as m from d)
    select id, case when s then 'S' else 'N' end as ref, d || '/1 ' || m || '/1 ' || cast(floor(((a - d) * 60 - m) * 6000 + 1e-4) as bigint) || '/100' as dms from m""")
def dms_format(spark, sf_dir):
    a = F.abs("latitude")
    got = positions(spark, sf_dir).select("id", (F.col("latitude") < 0).alias("s"), a.alias("a")).withColumn("d", F.floor(F.col("a") + 1e-9))
    got = got.withColumn("m", F.floor((F.col("a") - F.col("d")) * 60 + 1e-7))
    sec = F.floor(((F.col("a") - F.col("d")) * 60 - F.col("m")) * 6000 + 1e-4)
    return got.select("id", F.when(F.col("s"), "S").otherwise("N").alias("ref"), F.format_string("%d/1 %d/1 %d/100", "d", "m", sec).alias("dms"))


@query("dms_parse", f"with {GEO}, p as (select id, id % 90 as d, id % 60 as m, (id % 600) / 10e0 as s from geo) select id, round({geo.dms('d', 'm', 's')}, 9) as degrees from p")
def dms_parse(spark, sf_dir):
    k = F.col("id")
    parts = positions(spark, sf_dir).select("id", (k % 90).alias("d"), (k % 60).alias("m"), ((k % 600) / 10.0).alias("s"))
    return parts.select("id", F.round(F.expr(geo.dms("d", "m", "s")), 9).alias("degrees"))


_RES0 = 2 * geo.ORIGIN_SHIFT / geo.TILE


@query("zoom_table", f"select cast(i as int) as zoom, power(2e0, i) as n_tiles, round({_RES0!r} / power(2e0, i), 9) as resolution from (select unnest(range(35)) as i)")
def zoom_table(spark, sf_dir):
    return tiles.zoom_table(spark).withColumn("resolution", F.round("resolution", 9))


@query("zoom_resolution", f"with {GEO}, z as (select id, latitude, id % 20 as zoom from geo) select id, round({geo.zoom_resolution('zoom', 'latitude')}, 6) as resolution from z")
def zoom_resolution(spark, sf_dir):
    z = positions(spark, sf_dir).withColumn("zoom", F.col("id") % 20)
    return z.select("id", F.round(F.expr(geo.zoom_resolution("zoom", "latitude")), 6).alias("resolution"))


@query("zoom_for_gsd", f"with {FRAMES}, g as (select frame_id, altitude / 1200e0 as gsd from frames), t as (select cast(i as int) as zoom, {_RES0!r} / power(2e0, i) as res from (select unnest(range(35)) as i)) select frame_id, coalesce((select min(zoom) from t where gsd >= res + 0.01), 34) as zoom from g")
def zoom_for_gsd(spark, sf_dir):
    return tiles.zoom_for_gsd(frames(spark, sf_dir).select("frame_id", (F.col("altitude") / 1200.0).alias("gsd")), "gsd").select("frame_id", "zoom")


_MX, _MY = "1173000e0 + x * 40e0", "6851000e0 + y * 40e0"
_KEYS = f"k as (select *, {geo.meters_to_pixels('mx', '16')} as px, {geo.meters_to_pixels('my', '16')} as py from (select {_MX} as mx, {_MY} as my, z from points))"


def _mercator(spark, sf_dir):
    return points(spark, sf_dir).select(F.expr(_MX).alias("mx"), F.expr(_MY).alias("my"), "z")


@query("tile_from_meters", f"with {POINTS}, {_KEYS} select {geo.pixel_tile('px')} as tx, {geo.pixel_tile('py')} as ty, count(*) as n, max(px) as px, max(py) as py from k group by all")
def tile_from_meters(spark, sf_dir):
    return tiles.keyed(_mercator(spark, sf_dir), "mx", "my", 16).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.max("px").alias("px"), F.max("py").alias("py"))


@query("meters_from_pixels", f"with {GEO} select id, round({geo.pixels_to_meters('id * 100', '14')}, 5) as m from geo")
def meters_from_pixels(spark, sf_dir):
    return positions(spark, sf_dir).select("id", F.round(F.expr(geo.pixels_to_meters("id * 100", "14")), 5).alias("m"))


@query("tile_bounds", f"""with {FRAMES}, r as (select frame_id, easting * 2 as x, northing * 1.1e0 as y, altitude * 10 as width, altitude * 8 as height from frames)
    select frame_id, {geo.pixel_tile(geo.meters_to_pixels('x', '15'))} as tx0, {geo.pixel_tile(geo.meters_to_pixels('y', '15'))} as ty0,
    {geo.pixel_tile(geo.meters_to_pixels('(x + width)', '15'))} - ({geo.pixel_tile(geo.meters_to_pixels('x', '15'))}) + 1 as n_x, {geo.pixel_tile(geo.meters_to_pixels('(y + height)', '15'))} - ({geo.pixel_tile(geo.meters_to_pixels('y', '15'))}) + 1 as n_y from r""")
def tile_bounds(spark, sf_dir):
    r = frames(spark, sf_dir).select("frame_id", (F.col("easting") * 2).alias("x"), (F.col("northing") * 1.1).alias("y"), (F.col("altitude") * 10).alias("width"), (F.col("altitude") * 8).alias("height"))
    return tiles.tile_bounds(r, 15).select("frame_id", "tx0", "ty0", "n_x", "n_y")


@query("tile_from_latlon", f"with {GEO} select id, {geo.tile_x('longitude', '13e0')} as tx, {geo.tile_y('latitude', '13e0')} as ty from geo")
def tile_from_latlon(spark, sf_dir):
    return positions(spark, sf_dir).select("id", F.expr(geo.tile_x("longitude", "13e0")).alias("tx"), F.expr(geo.tile_y("latitude", "13e0")).alias("ty"))


@query("tile_latlon", f"with {GEO} select id, round({geo.tile_lon('id % 2048', '11')}, 8) as lon, round({geo.tile_lat('id % 2048', '11')}, 8) as lat from geo")
def tile_latlon(spark, sf_dir):
    return positions(spark, sf_dir).select("id", F.round(F.expr(geo.tile_lon("id % 2048", "11")), 8).alias("lon"), F.round(F.expr(geo.tile_lat("id % 2048", "11")), 8).alias("lat"))


@query("tile_pyramid", f"""with {POINTS}, {_KEYS}, l as (select 16 - up as zoom, cast(floor(px / power(2e0, up)) as bigint) as px, cast(floor(py / power(2e0, up)) as bigint) as py, z from k, (select unnest(range(6)) as up))
    select cast(zoom as int) as zoom, {geo.pixel_tile('px')} as tx, {geo.pixel_tile('py')} as ty, px, py, round(avg(z), 4) as z, count(*) as n from l group by zoom, px, py""")
def tile_pyramid(spark, sf_dir):
    return tiles.pyramid(_mercator(spark, sf_dir), 11, 16).withColumn("z", F.round("z", 4))


_PREDICT = f"with {FRAMES}, p as (select *, coalesce(2 * easting - lag(easting) over w, easting) as next_x, coalesce(2 * northing - lag(northing) over w, northing) as next_y from frames window w as (partition by camera_id order by ts, frame_id))"


def _predicted(spark, sf_dir):
    f = frames(spark, sf_dir).select("frame_id", "camera_id", "ts", F.col("easting").alias("x"), F.col("northing").alias("y"))
    return tiles.predicted_rect(f, "camera_id", ["ts", "frame_id"], ("x", "y"))


@query("roi_prediction", f"{_PREDICT} select frame_id, next_x, next_y from p")
def roi_prediction(spark, sf_dir):
    return _predicted(spark, sf_dir).select("frame_id", "next_x", "next_y")


@query("evict_tiles", f"""{_PREDICT}, l as (select camera_id, arg_max(next_x, {{'a': ts, 'b': frame_id}}) as nx, arg_max(next_y, {{'a': ts, 'b': frame_id}}) as ny from p group by camera_id),
    t as (select distinct camera_id, cast(floor(easting / 50) as bigint) as tx, cast(floor(northing / 50) as bigint) as ty from frames)
    select camera_id, tx, ty from t join l using (camera_id) where not (tx between floor(nx / 50) - 3 and floor(nx / 50) + 3 and ty between floor(ny / 50) - 3 and floor(ny / 50) + 3)""")
def evict_tiles(spark, sf_dir):
    last = _predicted(spark, sf_dir).groupBy("camera_id").agg(F.max_by(F.struct("next_x", "next_y"), F.struct("ts", "frame_id")).alias("n"))
    x, y = F.floor(F.col("n.next_x") / 50), F.floor(F.col("n.next_y") / 50)
    rect = last.select("camera_id", (x - 3).alias("tx0"), (x + 3).alias("tx1"), (y - 3).alias("ty0"), (y + 3).alias("ty1"))
    cached = frames(spark, sf_dir).select("camera_id", F.floor(F.col("easting") / 50).alias("tx"), F.floor(F.col("northing") / 50).alias("ty")).distinct()
    return tiles.evicted(cached, rect)


@query("warp_mercator")
def warp_mercator(spark, sf_dir):
    f = frames(spark, sf_dir)
    cells = f.select(F.round(F.col("easting") / 10).cast("long").alias("gx"), F.round(F.col("northing") / 10).cast("long").alias("gy"), "altitude").groupBy("gx", "gy").agg(F.min("altitude").alias("elevation"))
    return tiles.warp_to_mercator(cells, 10.0, 32, "elevation", 15.0)
