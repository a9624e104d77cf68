"""The streamed pose stage against its batch forms, across restarts, and its timers."""

import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.operators import stages
from skylattice.streaming import pose


def frames(spark, n=240):
    k = F.col("id")
    return spark.range(n).select(
        (k % 5).alias("camera_id"), k.alias("frame_id"), F.timestamp_seconds(1_700_000_000 + k).alias("ts"), (k % 7 == 0).cast("int").alias("is_keyframe"),
        (F.pmod(F.xxhash64("id"), F.lit(4 + k % 5)) != 0).cast("int").alias("has_pose"), (k * 1.5).alias("easting"), (k % 11).cast("double").alias("northing"),
    )


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    pose.use_rocksdb(spark)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def in_parts(spark, df, path, parts):
    """df as files that a stream takes one a batch, in the order of ts."""
    for p in range(parts):
        df.where((F.col("frame_id") * parts / 240).cast("int") == p).coalesce(1).write.parquet(f"{path}/{p}")
        time.sleep(0.01)


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("lost", [None, 2])
def test_streamed_release_goes_on_after_a_restart(rocks, tmp_path, lost):
    spark, f = rocks, frames(rocks)
    want = rows(stages.released_sessions(f, 3, lost).select("camera_id", "frame_id", "session", "release_ts"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    in_parts(spark, f.where("frame_id < 120"), str(tmp_path / "in/a"), 4)

    def run():
        stream = pose.released_stream(source(spark, f, str(tmp_path / "in")), 3, lost)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema("camera_id long, frame_id long, session int, release_ts timestamp").parquet(out))

    first = run()
    assert 0 < len(first) < len(want) and set(first) <= set(want) | {r for r in first if r[1] < 120}
    in_parts(spark, f.where("frame_id >= 120"), str(tmp_path / "in/b"), 4)
    assert run() == want


def test_sessions_without_resets_are_the_window_form(spark):
    f = frames(spark)
    by_window = stages.released(f, 3).where("release_ts is not null").select("frame_id", "release_ts")
    assert rows(stages.released_sessions(f, 3).select("frame_id", "release_ts")) == rows(by_window)
    starts = stages.pose_sessions(f, 30, 2).groupBy("camera_id").agg(F.max("session")).collect()
    lost = f.where("has_pose = 0").groupBy("camera_id").count().collect()
    assert {r[0]: r[1] for r in starts} == {r[0]: r[1] // 3 for r in lost}


def test_streamed_windows(rocks, tmp_path):
    spark, f = rocks, frames(rocks)
    in_parts(spark, f, str(tmp_path / "in"), 6)
    stream = pose.windows_stream(source(spark, f, str(tmp_path / "in")), 4)
    stream.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    w = W.partitionBy("camera_id").orderBy("ts", "frame_id")
    ids = F.collect_list("frame_id").over(w.rowsBetween(-3, 0))
    back = F.sqrt(F.pow(F.col("easting") - F.lag("easting", 3).over(w), 2) + F.pow(F.col("northing") - F.lag("northing", 3).over(w), 2))
    want = f.select("camera_id", "frame_id", ids.alias("frames"), F.round(back, 9).alias("baseline")).where(F.size("frames") == 4)
    got = spark.table("windows").select("camera_id", "frame_id", "frames", F.round("baseline", 9).alias("baseline"))
    assert rows(got) == rows(want)


def test_timers_pace_the_frames(rocks, tmp_path):
    """Frames half a second apart in the camera go out by timers, each not before it is due and in order; those due at once go out at once."""
    spark = rocks
    rows_ = [(1, k, 1_700_000_000_000 + 1500 * k, int(k == 0)) for k in range(5)] + [(2, 10, 1_700_000_000_000, 0), (2, 11, 1_700_000_001_000, 1), (None, 12, 0, 0)]
    f = spark.createDataFrame(rows_, "camera_id long, frame_id long, ms long, is_keyframe int").select("camera_id", "frame_id", F.timestamp_millis("ms").alias("ts"), "is_keyframe")
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pose.paced_stream(source(spark, f, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="400 milliseconds").start()
    try:
        seen, until = [], time.time() + 60
        while time.time() < until and len(seen) < 7:
            seen = [r.asDict() for r in spark.table("paced").collect()]
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted(r["frame_id"] for r in seen) == [0, 1, 2, 3, 4, 10, 11]
    assert all(r["out_ms"] >= r["due_ms"] for r in seen)
    one = sorted((r for r in seen if r["camera_id"] == 1), key=lambda r: r["frame_id"])
    assert [b["due_ms"] - a["due_ms"] for a, b in zip(one, one[1:])] == [1500] * 4 and [r["out_ms"] for r in one] == sorted(r["out_ms"] for r in one)
    assert len({r["out_ms"] for r in one}) > 1
    two = {r["frame_id"]: r for r in seen if r["camera_id"] == 2}
    assert two[11]["due_ms"] == two[10]["due_ms"] == two[11]["out_ms"]  # the first keyframe is the new reference
