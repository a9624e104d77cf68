"""Mapping tables derived from the driver tables: as DataFrames, and as SQL text for the oracles.

An observation's order is a struct of the whole lineitem key, so no global sort numbers the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Orders and events after which maps, clouds, frames and cameras go on beside those before: the tables of a larger scale cover more ground.
STRIDE, EVENTS = 15_000, 10_000
_ORDER_SQL = "{" + ", ".join(f"'{c}': {c}" for c in ORDER) + "}"


def strip(column: str, many: int = STRIDE):
    """The number of the stretch that a row's key lies in."""
    return F.floor(F.col(column) / many)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, frame_id, gx, gy, color, elevation, angle, elevated: what frames saw of lattice cells."""
    return table(spark, sf_dir, "lineitem").select(
        F.struct(*ORDER).alias("seq"), (F.col("l_orderkey") % 50).alias("frame_id"), (F.col("l_partkey") % 64 + 64 * strip("l_orderkey")).alias("gx"), (F.col("l_suppkey") % 64).alias("gy"),
        F.col("l_extendedprice").alias("color"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("elevation"),
        (F.col("l_discount") * 800 + F.col("l_extendedprice") % 10).alias("angle"), F.when(F.col("l_returnflag") == "R", 0).otherwise(255).alias("elevated"),
    )


OBS = f"""obs as (select {_ORDER_SQL} as seq, l_orderkey % 50 as frame_id, l_partkey % 64 + 64 * (l_orderkey // {STRIDE}) as gx, l_suppkey % 64 as gy, l_extendedprice as color,
  case when l_linenumber <> 7 then l_quantity end as elevation, l_discount * 800 + l_extendedprice % 10 as angle,
  case when l_returnflag = 'R' then 0 else 255 end as elevated from lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z and prior normals: a point cloud with repeated places."""
    return table(spark, sf_dir, "lineitem").select(
        F.struct(*ORDER).alias("point_id"), ((F.col("l_partkey") % 200) * 0.5 + F.col("l_discount") + 100.0 * strip("l_orderkey")).alias("x"), ((F.col("l_orderkey") % 200) * 0.5 + F.col("l_tax")).alias("y"),
        F.col("l_quantity").alias("z"), (F.col("l_discount") - 0.05).alias("nx"), (F.col("l_tax") - 0.04).alias("ny"), F.lit(1.0).alias("nz"),
    )


POINTS = f"""points as (select {_ORDER_SQL} as point_id, (l_partkey % 200) * 0.5e0 + l_discount + 100e0 * (l_orderkey // {STRIDE}) as x, (l_orderkey % 200) * 0.5e0 + l_tax as y, l_quantity as z,
  l_discount - 0.05e0 as nx, l_tax - 0.04e0 as ny, 1e0 as nz from lineitem)"""


def depth_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, r, c, depth of frames of 40 x 50 pixels; the earliest row of each pixel counts."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 8 + 8 * strip("l_orderkey")).alias("frame_id"), (F.col("l_partkey") % 40).alias("r"), (F.col("l_orderkey") % 50).alias("c"),
        F.when(F.col("l_discount") != 0, 80 + F.col("l_quantity")).alias("depth"), F.struct(*ORDER).alias("seq"),
    )
    return rows.groupBy("frame_id", "r", "c").agg(F.min(F.struct("seq", "depth")).alias("first")).select("frame_id", "r", "c", "first.depth")


DEPTH = f"""depth as (select frame_id, r, c, depth from (select l_suppkey % 8 + 8 * (l_orderkey // {STRIDE}) as frame_id, l_partkey % 40 as r, l_orderkey % 50 as c,
  case when l_discount <> 0 then 80e0 + l_quantity end as depth, row_number() over (partition by l_suppkey % 8 + 8 * (l_orderkey // {STRIDE}), l_partkey % 40, l_orderkey % 50 order by {", ".join(ORDER)}) as rn
  from lineitem) where rn = 1)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with geotag and flags; order within a camera: ts, frame_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("frame_id"), "ts", (F.col("user_id") % 97 + 97 * strip("event_id", EVENTS)).alias("camera_id"), (604000.0 + (F.col("event_id") % 100) * 10.0).alias("easting"),
        (5792000.0 + (F.col("event_id") % 37) * 15.0).alias("northing"), (100.0 + F.col("value") / 10.0).alias("altitude"), ((F.col("user_id") * 7) % 360).cast("double").alias("heading"),
        F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(0).alias("is_keyframe"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("has_pose"),
        F.when(F.col("event_type") == "view", 0).otherwise(1).alias("has_surface"),
    )


FRAMES = f"""frames as (select event_id as frame_id, ts, user_id % 97 + 97 * (event_id // {EVENTS}) as camera_id, 604000e0 + (event_id % 100) * 10e0 as easting,
  5792000e0 + (event_id % 37) * 15e0 as northing, 100e0 + value / 10e0 as altitude, cast((user_id * 7) % 360 as double) as heading,
  case when event_type in ('purchase', 'click') then 1 else 0 end as is_keyframe, case when event_type = 'error' then 0 else 1 end as has_pose,
  case when event_type = 'view' then 0 else 1 end as has_surface from events)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GNSS and visual positions of 61 cameras a stretch of orders, in the order of seq."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 61 + 61 * strip("o_orderkey")).alias("camera_id"), F.col("o_orderkey").alias("seq"), ((F.col("o_orderkey") % 500) * 1.0).alias("gx"), ((F.col("o_custkey") % 300) * 1.0).alias("gy"),
        F.lit(100.0).alias("gz"), ((F.col("o_orderkey") % 500) * 0.25 + (F.col("o_orderkey") % 7) * 0.01).alias("vx"), ((F.col("o_custkey") % 300) * 0.25).alias("vy"), F.lit(25.0).alias("vz"),
    )


POSES = f"""poses as (select o_custkey % 61 + 61 * (o_orderkey // {STRIDE}) as camera_id, o_orderkey as seq, (o_orderkey % 500) * 1e0 as gx, (o_custkey % 300) * 1e0 as gy, 100e0 as gz,
  (o_orderkey % 500) * 0.25e0 + (o_orderkey % 7) * 0.01e0 as vx, (o_custkey % 300) * 0.25e0 as vy, 25e0 as vz from orders)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WGS84 positions all over the world."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (-79.0 + ((k * 37) % 16200) / 100.0).alias("latitude"), (-179.5 + ((k * 241) % 35900) / 100.0).alias("longitude"), F.col("c_acctbal").alias("altitude"),
    )


GEO = """geo as (select c_custkey as id, -79e0 + ((c_custkey * 37) % 16200) / 100e0 as latitude, -179.5e0 + ((c_custkey * 241) % 35900) / 100e0 as longitude,
  c_acctbal as altitude from customer)"""
