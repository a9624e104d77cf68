"""Queries of stage bookkeeping over frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import stages
from skylattice.plans.catalog import query
from skylattice.plans.fixtures import EVENTS, FRAMES, frames

_RULES = {"densify": "is_keyframe = 1 and has_pose = 1", "ortho": "has_surface = 1", "mosaic": "has_surface = 1 and has_pose = 1"}
_W = "window w as (partition by camera_id order by ts, frame_id)"


@query("admission_counts", f"with {FRAMES} " + " union all ".join(f"select '{n}' as stage, camera_id, count(*) as n_total, count(*) - count(*) filter ({r}) as n_bad, count(*) filter ({r}) as n_processed from frames group by camera_id" for n, r in _RULES.items()))
def admission_counts(spark, sf_dir):
    return stages.admission_counts(frames(spark, sf_dir), {n: F.expr(r) for n, r in _RULES.items()})


@query("queue_keep_latest", f"with {FRAMES} select camera_id, frame_id from (select *, row_number() over (partition by camera_id order by ts desc, frame_id desc) as rn from frames) where rn <= 5")
def queue_keep_latest(spark, sf_dir):
    return stages.keep_latest(frames(spark, sf_dir)).select("camera_id", "frame_id")


@query("stage_stats", f"with {FRAMES} select camera_id, is_keyframe, count(*) as n, min(altitude) as min, max(altitude) as max, round(avg(altitude), 6) as mean from frames group by all")
def stage_stats(spark, sf_dir):
    return stages.statistics(frames(spark, sf_dir), "altitude", "camera_id", "is_keyframe").withColumn("mean", F.round("mean", 6))


@query("fps_10s", f"with {FRAMES} select camera_id, make_timestamp(epoch_us(ts) // 10000000 * 10000000) as start, count(*) / 10e0 as fps from frames group by all")
def fps_10s(spark, sf_dir):
    return stages.frame_rates(frames(spark, sf_dir))


@query("every_nth", f"with {FRAMES} select frame_id, nth from (select frame_id, cast(row_number() over (partition by camera_id order by ts, frame_id) as int) as nth from frames where is_keyframe = 1) where nth % 5 = 0")
def every_nth(spark, sf_dir):
    return stages.every_nth(frames(spark, sf_dir), 5).select("frame_id", "nth")


@query("slam_state", f"""with {FRAMES}, p as (select frame_id, frame_id // 300 as k, lag(frame_id // 300) over w as before from frames where has_pose = 1 {_W})
    select frame_id, case when before is null then 'INITIALIZED' when before <> k then 'KEYFRAME_INSERT' else 'FRAME_INSERT' end as state from p union all select frame_id, 'LOST' from frames where has_pose = 0""")
def slam_state(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("keyframe_id", F.floor(F.col("frame_id") / 300))
    return stages.tracking_state(f).select("frame_id", "state")


@query("lost_reset_sessions", f"""with {FRAMES}, n as (select *, sum(case when is_keyframe = 1 and has_pose = 1 then 1 else 0 end) over w as nth from frames {_W}),
    l as (select frame_id, sum(case when has_pose = 0 and nth < 30 then 1 else 0 end) over w as lost from n {_W}) select frame_id, cast(lost // 4 as bigint) as session from l""")
def lost_reset_sessions(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("nth", stages.keyframes_so_far())
    return stages.lost_sessions(f, 3, F.col("nth") >= 30).select("frame_id", "session")


@query("stereo_window", f"""with {FRAMES}, n as (select frame_id, round(sqrt(power(easting - lag(easting, 2) over w, 2) + power(northing - lag(northing, 2) over w, 2)), 4) as back, round(sqrt(power(easting - lead(easting) over w, 2) + power(northing - lead(northing) over w, 2)), 4) as ahead from frames {_W}) select * from n""")
def stereo_window(spark, sf_dir):
    w = stages.sequence()
    gap = lambda f: F.round(F.sqrt(F.pow(F.col("easting") - f("easting"), 2) + F.pow(F.col("northing") - f("northing"), 2)), 4)
    return frames(spark, sf_dir).select("frame_id", gap(lambda c: F.lag(c, 2).over(w)).alias("back"), gap(lambda c: F.lead(c).over(w)).alias("ahead"))


@query("delayed_publish", f"with {FRAMES}, t as (select frame_id, epoch_us(ts) - epoch_us(min(ts) over (partition by camera_id)) as elapsed from frames) select frame_id, elapsed from t where elapsed > 600000000")
def delayed_publish(spark, sf_dir):
    from pyspark.sql import Window as W

    us = lambda c: F.unix_micros(c.cast("timestamp"))
    first = F.min("ts").over(W.partitionBy("camera_id"))
    return frames(spark, sf_dir).select("frame_id", (us(F.col("ts")) - us(first)).alias("elapsed")).where("elapsed > 600000000")


@query("released_frames", f"""with {FRAMES}, n as (select *, sum(case when is_keyframe = 1 and has_pose = 1 then 1 else 0 end) over w as nth from frames {_W}),
    r as (select *, min(case when nth >= 3 then ts end) over (partition by camera_id) as ready from n) select frame_id, case when ready is not null then greatest(ts, ready) end as release_ts from r where has_pose = 1""")
def released_frames(spark, sf_dir):
    return stages.released(frames(spark, sf_dir), 3).select("frame_id", "release_ts")


@query("released_sessions", f"""with recursive {FRAMES}, n as materialized (select camera_id, frame_id, ts, is_keyframe, has_pose, row_number() over (partition by camera_id order by ts, frame_id) as k from frames),
    fold as (select distinct camera_id, cast(0 as bigint) as k, 0 as session, 0 as nth, 0 as missed, cast(null as bigint) as frame_id, cast(null as bigint) as us, 0 as has_pose from n
      union all select camera_id, k, session + reset, case when reset = 1 then 0 else nth end + case when is_keyframe = 1 and pose = 1 then 1 else 0 end, now_missed, frame_id, us, pose from
      (select camera_id, k, session, nth, now_missed, frame_id, us, pose, is_keyframe, case when pose = 0 and nth < 3 and now_missed % 3 = 0 then 1 else 0 end as reset from
        (select n.camera_id, n.k, f.session, f.nth, f.missed + case when n.has_pose = 0 and f.nth < 3 then 1 else 0 end as now_missed, n.frame_id, epoch_us(n.ts) as us, n.has_pose as pose, n.is_keyframe
         from fold f join n on n.camera_id = f.camera_id and n.k = f.k + 1))),
    r as (select *, min(case when nth >= 3 then us end) over (partition by camera_id, session) as ready from fold where k > 0)
    select frame_id, session, greatest(us, ready) as release_us from r where has_pose = 1 and ready is not null""")
def released_sessions(spark, sf_dir):
    got = stages.released_sessions(frames(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), 3, 2)
    return got.select("frame_id", "session", F.unix_micros("release_ts").alias("release_us"))


@query("imu_intervals", f"""with {FRAMES}, i as (select event_id as reading_id, user_id % 97 + 97 * (event_id // {EVENTS}) as sensor_id, ts as read_at, value from events)
    select frame_id, count(*) as n, round(avg(value), 6) as mean from frames f join i on i.sensor_id = f.camera_id and i.read_at <= f.ts and i.read_at > f.ts - interval '2 hours' group by frame_id""")
def imu_intervals(spark, sf_dir):
    from skylattice.plans.fixtures import strip, table
    from skylattice.streaming.maps import frames_with_imu

    readings = table(spark, sf_dir, "events").select(F.col("event_id").alias("reading_id"), (F.col("user_id") % 97 + 97 * strip("event_id", EVENTS)).alias("sensor_id"), F.col("ts").cast("timestamp").alias("at"), "value")
    timed = frames(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return frames_with_imu(timed, readings, "2 hours").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
