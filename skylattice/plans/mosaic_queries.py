"""Queries of the mosaic and tile aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import mosaic
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import OBS, observations

MOSAIC = """o as (select * from obs where angle > 0 and elevation is not null),
  r as (select *, max(angle) over (partition by gx, gy order by seq rows between unbounded preceding and 1 preceding) as best from o),
  m as (select gx, gy, arg_min(color, {'a': -angle, 's': seq}) as color, arg_min(elevation, {'a': -angle, 's': seq}) as elevation, max(angle) as angle,
    cast(sum(case when best is null or angle > best then 1 else 0 end) as bigint) as n_obs from r group by gx, gy)"""


@query("mosaic_blend", f"with {OBS}, {MOSAIC} select * from m")
def mosaic_blend(spark, sf_dir):
    return mosaic.blend(observations(spark, sf_dir))


@query("mosaic_elevated", f"with {OBS} select gx, gy, max(elevated) as elevated from obs group by gx, gy")
def mosaic_elevated(spark, sf_dir):
    return mosaic.elevated(observations(spark, sf_dir))


@query("mosaic_first_valid", f"with {OBS} select gx, gy, arg_min(elevation, seq) as elevation from obs where elevation is not null group by gx, gy")
def mosaic_first_valid(spark, sf_dir):
    return mosaic.first_valid(observations(spark, sf_dir))


_TILE = "select gx, gy, l.color, l.elevation, l.angle, l.elevated from (select gx, gy, arg_max({'color': color, 'elevation': elevation, 'angle': angle, 'elevated': elevated}, seq) as l from obs where frame_id %s 25 group by gx, gy)"


@query(
    "tile_blend_pair",
    f"""with {OBS}, n as ({_TILE % '>='}), o as ({_TILE % '<'}), j as (select gx, gy, n, o, o.elevation is not null and (n is null or not (o.angle < n.angle or (o.elevated > 0 and n.elevated = 0))) as keep
      from (select gx, gy, {{'color': color, 'elevation': elevation, 'angle': angle, 'elevated': elevated}} as n from n) full join
      (select gx, gy, {{'color': color, 'elevation': elevation, 'angle': angle, 'elevated': elevated}} as o from o) using (gx, gy)),
    c as (select gx, gy, case when keep then o else coalesce(n, o) end as c from j) select gx, gy, c.color, c.elevation, c.angle, c.elevated from c""",
)
def tile_blend_pair(spark, sf_dir):
    obs = observations(spark, sf_dir)
    last = lambda df: df.groupBy("gx", "gy").agg(F.max_by(F.struct("color", "elevation", "angle", "elevated"), "seq").alias("l")).select("gx", "gy", "l.*")
    return mosaic.blend_tiles(last(obs.where("frame_id >= 25")), last(obs.where("frame_id < 25")))


@query(
    "tile_merge_latest",
    f"""with {OBS} select gx, gy, arg_max(elevation, seq) filter (elevation is not null) as elevation, arg_max(elevated, seq) filter (elevated > 0) as elevated from obs group by gx, gy""",
)
def tile_merge_latest(spark, sf_dir):
    return mosaic.merge_latest(observations(spark, sf_dir))


@query(
    "tile_last_write",
    f"with {OBS} select gx, gy, l.color, l.elevation, l.angle from (select gx, gy, arg_max({{'color': color, 'elevation': elevation, 'angle': angle}}, seq) as l from obs group by gx, gy)",
)
def tile_last_write(spark, sf_dir):
    return mosaic.last_write(observations(spark, sf_dir))
