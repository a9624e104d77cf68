"""The pose stage as streams: buffers that wait for a georeference, publishing at a frame's pace, windows of the last frames.

Each camera is a key with state of its own, kept by Spark's state store, so a query that starts again from its
checkpoint goes on where it stopped. The store has to be RocksDB's (`use_rocksdb`), as lists and timers need it. Frames of a
camera are taken in the order of their batches, and within a batch in the order of ts and frame_id. Rows without a
camera or ts are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skylattice.operators.stages import PoseSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Set the session's state store; a running query keeps the one that it started with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_order(batches) -> pd.DataFrame:
    rows = pd.concat(list(batches), ignore_index=True)
    return rows.sort_values(["us", "frame_id"], kind="stable")


class _Release(StatefulProcessor):
    """Holds posed frames until the georeference stands, then passes them on."""

    def __init__(self, keyframes: int, lost: int | None) -> None:
        self.keyframes, self.lost = keyframes, lost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("session", "session int, nth int, missed int")
        self.waiting = handle.getListState("waiting", "frame_id long, us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session = PoseSession(self.keyframes, self.lost, tuple(self.at.get()) if self.at.exists() else (0, 0, 0))
        out, new, old_session, stood = [], [], session.session, session.stands
        for frame, us, keyframe, posed in _in_order(rows)[["frame_id", "us", "is_keyframe", "has_pose"]].itertuples(index=False, name=None):
            session.step(bool(keyframe), bool(posed))
            if session.session != old_session:  # what waited is given up
                self.waiting.clear()
                new, old_session = [], session.session
            if session.stands and not stood:
                out += [(f, session.session, us) for f, _ in [*self.waiting.get(), *new]]
                self.waiting.clear()
                new, stood = [], True
            if posed:
                if session.stands:
                    out.append((frame, session.session, us))
                else:
                    new.append((int(frame), int(us)))
        if new:
            self.waiting.appendList(new)
        self.at.update(session.state)
        yield pd.DataFrame({"camera_id": [key[0]] * len(out), "frame_id": [o[0] for o in out], "session": [o[1] for o in out], "us": [o[2] for o in out]})

    def close(self) -> None:
        pass


def _with_micros(frames: DataFrame, *columns: str) -> DataFrame:
    return frames.where("camera_id is not null and ts is not null").select("camera_id", "frame_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *columns)


def released_stream(frames: DataFrame, keyframes: int, lost: int | None = None) -> DataFrame:
    """camera_id, frame_id, session and release_ts of a stream of frames (camera_id, frame_id, ts, is_keyframe, has_pose), as stages.released_sessions has them."""
    rows = _with_micros(frames, "is_keyframe", "has_pose").groupBy("camera_id")
    out = rows.transformWithStateInPandas(_Release(keyframes, lost), "camera_id long, frame_id long, session int, us long", "append", "None")
    return out.select("camera_id", "frame_id", "session", F.timestamp_micros("us").alias("release_ts"))


class _Paced(StatefulProcessor):
    """Passes each frame on as long after its camera's reference frame as it was taken after it."""

    def __init__(self, speed: float) -> None:
        self.speed = speed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reference = handle.getValueState("reference", "world_ms long, us long, is_keyframe boolean")
        self.due = handle.getMapState("due", "at_ms long, frame_id long", "us long")

    def _out(self, key, frames, now: int) -> pd.DataFrame:
        return pd.DataFrame({"camera_id": [key[0]] * len(frames), "frame_id": [f[1] for f in frames], "due_ms": [f[0] for f in frames], "out_ms": [now] * len(frames)})

    def _take(self, now: int) -> list[tuple[int, int]]:
        ready = sorted((at, frame) for at, frame in self.due.keys() if at <= now)  # noqa: SIM118
        for at, frame in ready:
            self.due.removeKey((at, frame))
        return ready

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        world, us, by_keyframe = self.reference.get() if self.reference.exists() else (None, None, False)
        for frame, taken, keyframe in _in_order(rows)[["frame_id", "us", "is_keyframe"]].itertuples(index=False, name=None):
            if world is None or (keyframe and not by_keyframe):  # the first frame, and again the first keyframe
                world, us, by_keyframe = now, int(taken), bool(keyframe)
                self.reference.update((world, us, by_keyframe))
            at = int(world + (taken - us) / 1000 / self.speed)
            self.due.updateValue((at, int(frame)), (int(taken),))
            if at > now:
                self.handle.registerTimer(at)
        yield self._out(key, self._take(now), now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        yield self._out(key, self._take(now), now)

    def close(self) -> None:
        pass


def paced_stream(frames: DataFrame, speed: float = 1.0) -> DataFrame:
    """camera_id, frame_id, due_ms and out_ms (world time) of a stream of frames: a frame goes out once as much time has passed since its camera's reference
    frame as lies between the two, by timers; speed divides that. The first frame is the reference, until the first keyframe is."""
    rows = _with_micros(frames, "is_keyframe").groupBy("camera_id")
    return rows.transformWithStateInPandas(_Paced(speed), "camera_id long, frame_id long, due_ms long, out_ms long", "append", "ProcessingTime")


class _Window(StatefulProcessor):
    """The last frames of a camera."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "frame_id long, x double, y double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.last.get()) if self.last.exists() else []
        out = []
        for frame in _in_order(rows)[["frame_id", "easting", "northing"]].itertuples(index=False, name=None):
            held = [*held, (int(frame[0]), float(frame[1]), float(frame[2]))][-self.size :]
            if len(held) == self.size:
                first, last = held[0], held[-1]
                out.append((last[0], [h[0] for h in held], ((last[1] - first[1]) ** 2 + (last[2] - first[2]) ** 2) ** 0.5))
        self.last.put(held)
        yield pd.DataFrame({"camera_id": [key[0]] * len(out), "frame_id": [o[0] for o in out], "frames": [o[1] for o in out], "baseline": [o[2] for o in out]})

    def close(self) -> None:
        pass


def windows_stream(frames: DataFrame, size: int) -> DataFrame:
    """camera_id, frame_id, frames (ids of the last so many, itself included) and baseline (from the oldest of them to it) of every frame of a stream that has as many before it."""
    rows = _with_micros(frames, "easting", "northing").groupBy("camera_id")
    return rows.transformWithStateInPandas(_Window(size), "camera_id long, frame_id long, frames array<long>, baseline double", "append", "None")
