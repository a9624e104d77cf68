"""Stage bookkeeping over frame tables (frame_id, ts, camera_id, flags): admission, queues, rates, tracking state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.grid import intersection_area
from skylattice.operators.folds import folded


def sequence(by: str = "camera_id"):
    return W.partitionBy(by).orderBy("ts", "frame_id")


def admission_counts(frames: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """stage, camera_id, n_total, n_bad and n_processed: frames each stage's rule lets in."""
    wide = frames.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n_total"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return wide.select("camera_id", "n_total", F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("stage", "n_processed")).select(
        "stage", "camera_id", "n_total", (F.col("n_total") - F.col("n_processed")).alias("n_bad"), "n_processed"
    )


def keep_latest(frames: DataFrame, size: int = 5) -> DataFrame:
    """The newest frames of each camera that a queue of that size holds."""
    nth = F.row_number().over(W.partitionBy("camera_id").orderBy(F.col("ts").desc(), F.col("frame_id").desc()))
    return frames.withColumn("nth", nth).where(F.col("nth") <= size).drop("nth")


def statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, min, max and mean of a value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def frame_rates(frames: DataFrame, period: str = "10 seconds", *by: str) -> DataFrame:
    """Frames a second of each camera and period; by names further columns, such as whether frames came in or went out."""
    seconds = pd.Timedelta(period).total_seconds()
    counted = frames.groupBy("camera_id", *by, F.window("ts", period).alias("w")).agg((F.count(F.lit(1)) / seconds).alias("fps"))
    return counted.select("camera_id", *by, F.col("w.start").alias("start"), "fps")


def frame_counters(frames: DataFrame, admitted: Column, size: int = 5) -> DataFrame:
    """n_total, n_bad (not admitted), n_dropped (admitted, but pushed out of a queue of that size by newer ones) and n_processed of each camera.

    A frame's n_newer counts the frames that came in before the stage took it."""
    dropped = admitted & (F.col("n_newer") >= size)
    return frames.groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~admitted).alias("n_bad"), F.count_if(dropped).alias("n_dropped"), F.count_if(admitted & ~dropped).alias("n_processed")
    )


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    """Every n-th keyframe of each camera."""
    nth = F.row_number().over(sequence())
    return frames.where("is_keyframe = 1").withColumn("nth", nth).where(F.col("nth") % n == 0)


def tracking_state(frames: DataFrame, keyframe: str = "keyframe_id") -> DataFrame:
    """LOST without a pose, INITIALIZED at the first keyframe, KEYFRAME_INSERT when its id changes, else FRAME_INSERT."""
    posed = frames.where("has_pose = 1")
    before = F.lag(keyframe).over(sequence())
    state = F.when(before.isNull(), "INITIALIZED").when(before != F.col(keyframe), "KEYFRAME_INSERT").otherwise("FRAME_INSERT")
    return posed.withColumn("state", state).unionByName(frames.where("has_pose = 0").withColumn("state", F.lit("LOST")))


def lost_sessions(frames: DataFrame, most_lost: int, standing: Column | None = None) -> DataFrame:
    """session of each frame: a reset begins a new one whenever more than so many frames were lost since the last.

    Once a camera's georeference stands (the condition standing) lost frames reset nothing."""
    counts = (F.col("has_pose") == 0) & ~F.coalesce(standing if standing is not None else F.lit(False), F.lit(False))
    lost = F.sum(F.when(counts, 1).otherwise(0)).over(sequence())
    return frames.withColumn("session", F.floor(lost / (most_lost + 1)).cast("long"))


def keyframes_so_far() -> Column:
    """How many keyframes with a pose a camera has had, this frame included."""
    return F.sum(F.when((F.col("is_keyframe") == 1) & (F.col("has_pose") == 1), 1).otherwise(0)).over(sequence())


def overlap_with_previous(frames: DataFrame) -> DataFrame:
    """Percent of each frame's rectangle (x, y, width, height) that the previous frame covers."""
    w = sequence()
    now = tuple(F.col(c) for c in ("x", "y", "width", "height"))
    before = tuple(F.lag(c).over(w) for c in ("x", "y", "width", "height"))
    area = intersection_area(now, before)
    return frames.withColumn("overlap", F.when(F.lag("x").over(w).isNotNull(), area / (now[2] * now[3]) * 100))


class Throttle:
    """Publishes a frame when it overlaps the last published one by less than most percent."""

    def __init__(self, most: float, last: tuple | None = None) -> None:
        self.most, self.last = most, last

    def admits(self, rect: tuple) -> bool:
        if self.last is not None:
            a, b = rect, self.last
            w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
            h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
            if 100 * max(w, 0.0) * max(h, 0.0) / (a[2] * a[3]) >= self.most:
                return False
        self.last = rect
        return True


def throttled(frames: DataFrame, most: float) -> DataFrame:
    """frame_id and camera_id of frames published by a Throttle: a sequential choice per camera, as it depends on itself.

    A task folds its cameras' frames in order and holds one rectangle."""

    def start():
        gate = Throttle(most)
        return lambda row: row[:2] if gate.admits(row[2:6]) else None

    rows = frames.select("camera_id", "frame_id", "x", "y", "width", "height", "ts")
    return folded(rows, "camera_id", ["ts", "frame_id"], start, "camera_id long, frame_id long")


def published(frames: DataFrame, most: float = 70.0, most_fallback: float = 70.0, use_tracker: bool = True, use_fallback: bool = False) -> DataFrame:
    """camera_id, frame_id and why: keyframes that overlap the last published frame by less than most percent, and frames without an accurate
    pose by less than most_fallback, where a fallback is used; without a tracker every frame counts as such."""

    def start():
        last: list = [None]

        def step(row):
            camera, frame, x, y, width, height, keyframe, posed = row[:8]
            rect = (x, y, width, height)
            gnss = not use_tracker and Throttle(most_fallback, last[0]).admits(rect)
            tracked = bool(keyframe) and Throttle(most, last[0]).admits(rect)
            fallback = use_fallback and not posed and Throttle(most_fallback, last[0]).admits(rect)
            if gnss or tracked or fallback:
                last[0] = rect
                return camera, frame, "gnss" if gnss else "keyframe" if tracked else "fallback"
            return None

        return step

    rows = frames.select("camera_id", "frame_id", "x", "y", "width", "height", "is_keyframe", "has_pose", "ts")
    return folded(rows, "camera_id", ["ts", "frame_id"], start, "camera_id long, frame_id long, why string")


def current_poses(frames: DataFrame, backlog: str = "n_waiting") -> DataFrame:
    """Frames whose pose is still current when it is published: none that others wait behind."""
    return frames.where(F.col(backlog) <= 1)


def queue_statistics(depths: DataFrame) -> DataFrame:
    """stage, n, min, max and mean of sampled queue depths (stage, depth), and how many samples found the queue full (capacity)."""
    return statistics(depths, "depth", "stage").join(depths.groupBy("stage").agg(F.count_if(F.col("depth") >= F.col("capacity")).alias("n_full")), "stage")


def keyframe_links(frames: DataFrame, keyframes: DataFrame) -> DataFrame:
    """frames with link: the newest keyframe (camera_id, keyframe_id, ts) of their camera that is not newer than they are."""
    events = frames.select("camera_id", "ts", "frame_id", F.lit(None).cast("long").alias("keyframe_id"), F.lit(1).alias("kind"))
    marks = keyframes.select("camera_id", "ts", F.lit(None).cast("long").alias("frame_id"), F.col("keyframe_id").cast("long"), F.lit(0).alias("kind"))
    upto = W.partitionBy("camera_id").orderBy("ts", "kind", "keyframe_id").rowsBetween(W.unboundedPreceding, 0)
    linked = events.unionByName(marks).withColumn("link", F.last("keyframe_id", ignorenulls=True).over(upto))
    return linked.where("kind = 1").select("camera_id", "frame_id", "link")


def released(frames: DataFrame, keyframes: int) -> DataFrame:
    """release_ts of each posed frame: its own time, but not before its camera's georeference stands, which takes so many keyframes."""
    ready = F.min(F.when(F.col("nth_keyframe") >= keyframes, F.col("ts"))).over(W.partitionBy("camera_id"))
    posed = frames.withColumn("nth_keyframe", keyframes_so_far()).withColumn("ready_ts", ready).where("has_pose = 1")
    return posed.withColumn("release_ts", F.when(F.col("ready_ts").isNotNull(), F.greatest("ts", "ready_ts"))).drop("nth_keyframe", "ready_ts")


class PoseSession:
    """A camera's way to a georeference: it stands once a session has so many posed keyframes; before that, every (lost + 1)th frame without a pose starts a new session."""

    def __init__(self, keyframes: int, lost: int | None = None, state: tuple[int, int, int] = (0, 0, 0)) -> None:
        self.keyframes, self.lost, (self.session, self.nth, self.missed) = keyframes, lost, state

    @property
    def stands(self) -> bool:
        return self.nth >= self.keyframes

    @property
    def state(self) -> tuple[int, int, int]:
        return self.session, self.nth, self.missed

    def step(self, keyframe: bool, posed: bool) -> None:
        """Take the camera's next frame."""
        if not posed and not self.stands and self.lost is not None:
            self.missed += 1
            if self.missed % (self.lost + 1) == 0:
                self.session, self.nth = self.session + 1, 0
        self.nth += int(keyframe and posed)


def pose_sessions(frames: DataFrame, keyframes: int, lost: int | None = None) -> DataFrame:
    """camera_id, frame_id, ts, has_pose, session and whether the georeference stands at each frame: a fold, as sessions depend on earlier ones."""

    def start():
        at = PoseSession(keyframes, lost)

        def step(row):
            camera, frame, ts, keyframe, posed = row
            at.step(bool(keyframe), bool(posed))
            return camera, frame, ts, int(posed), at.session, at.stands

        return step

    rows = frames.select("camera_id", "frame_id", "ts", "is_keyframe", "has_pose")
    return folded(rows, "camera_id", ["ts", "frame_id"], start, "camera_id long, frame_id long, ts timestamp, has_pose int, session int, stands boolean")


def released_sessions(frames: DataFrame, keyframes: int, lost: int | None = None) -> DataFrame:
    """camera_id, frame_id, session and release_ts of the posed frames that are released: at their own time, but not before their session's georeference
    stands; a session that ends before has none."""
    seen = pose_sessions(frames, keyframes, lost)
    ready = F.min(F.when(F.col("stands"), F.col("ts"))).over(W.partitionBy("camera_id", "session"))
    posed = seen.withColumn("ready_ts", ready).where("has_pose = 1 and ready_ts is not null")
    return posed.select("camera_id", "frame_id", "session", F.greatest("ts", "ready_ts").alias("release_ts"))
