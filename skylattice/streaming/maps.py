"""The incremental map and per-camera streams, equal to their batch forms.

The mosaic's state is those observations of each cell whose angle rises above all earlier ones: one
that doesn't can't once more observations are known, so states merge in any order. It is kept as a
table laid out by blocks of cells; a micro-batch rewrites only the blocks that it touches, and the
folders of many batches are gathered into one from time to time.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from skylattice.operators import mosaic
from skylattice.operators.stages import Throttle

#: Cells along the side of a block of the state table, and batches whose folders are gathered into one.
BLOCK, GATHERED = 64, 50


class MosaicState:
    """A mosaic that grows by micro-batches of observations; path is a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _table(self, epoch: str) -> str:
        return f"{self.path}/{epoch}"

    def _blocks(self) -> DataFrame | None:
        """The current version of every block: a small manifest names the folder that holds it."""
        try:
            return self.spark.read.parquet(f"{self.path}/manifest").groupBy("bx", "by").agg(F.max_by("folder", "batch").alias("folder"))
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def observations(self, touched: DataFrame | None = None) -> DataFrame | None:
        """The kept observations; touched (bx, by) limits them to some blocks."""
        blocks = self._blocks()
        if blocks is None:
            return None
        if touched is not None:
            blocks = blocks.join(touched, ["bx", "by"], "left_semi")
        folders = [r[0] for r in blocks.select("folder").distinct().collect()]  # one a batch at most
        if not folders:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(*[self._table(f) for f in folders]).withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -4))
        return rows.join(blocks, ["bx", "by", "folder"], "left_semi").drop("folder")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function. A batch that comes again changes nothing."""
        cells = batch.select("seq", "gx", "gy", "color", "elevation", "angle", F.floor(F.col("gx") / BLOCK).alias("bx"), F.floor(F.col("gy") / BLOCK).alias("by"))
        seen = cells.where((F.col("angle") > 0) & F.col("elevation").isNotNull())
        touched = seen.select("bx", "by").distinct()
        old = self.observations(touched)
        every = seen if old is None else old.select(*seen.columns).unionByName(seen)
        self._write(mosaic.rising(every, "bx", "by", "gx", "gy"), f"batch-{batch_id}-{uuid.uuid4().hex[:8]}", float(batch_id))
        folders = self._blocks()
        if folders is not None and folders.select("folder").distinct().count() > GATHERED:
            self.compact()

    def _write(self, rows: DataFrame, folder: str, batch: float) -> None:
        rows.repartition("bx", "by").write.partitionBy("bx", "by").parquet(self._table(folder))
        try:
            done = self.spark.read.parquet(self._table(folder)).select(F.col("bx").cast("long"), F.col("by").cast("long")).distinct()
        except Exception as e:  # nothing was written
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return
        done.withColumns({"folder": F.lit(folder), "batch": F.lit(batch)}).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def compact(self) -> None:
        """Gather the current version of every block in one folder."""
        rows = self.observations()
        if rows is not None:
            newest = self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("batch")).first()[0]
            self._write(rows, f"gathered-{uuid.uuid4().hex[:8]}", newest + 0.5)

    def vacuum(self) -> None:
        """Delete folders that hold no current version, once nothing reads them any more."""
        blocks = self._blocks()
        used = {r[0] for r in blocks.select("folder").distinct().collect()} if blocks is not None else set()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(("batch-", "gathered-")) and name not in used:
                fs.delete(status.getPath(), True)

    def mosaic(self) -> DataFrame:
        """The mosaic of all observations so far."""
        rows = self.observations()
        if rows is None:
            raise ValueError("no observations yet")
        return mosaic.blend(rows)


def stream_mosaic(observations: DataFrame, state: MosaicState, checkpoint: str):
    """Start a query that merges a stream of observations into a mosaic state; it ends when the source has nothing new."""
    return observations.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled_stream(frames: DataFrame, most: float) -> DataFrame:
    """camera_id and frame_id of the frames of a stream that a Throttle of their camera publishes, in order of arrival and ts."""

    def step(key, pdfs, state):
        gate = Throttle(most, tuple(state.get) if state.exists else None)
        rows = pd.concat(list(pdfs)).sort_values(["ts", "frame_id"])
        keep = [gate.admits(r) for r in rows[["x", "y", "width", "height"]].itertuples(index=False, name=None)]
        if gate.last is not None:
            state.update(gate.last)
        yield rows.loc[keep, ["camera_id", "frame_id"]]

    rows = frames.select("camera_id", "frame_id", "ts", "x", "y", "width", "height")
    return rows.groupBy("camera_id").applyInPandasWithState(step, "camera_id long, frame_id long", "x double, y double, width double, height double", "append", GroupStateTimeout.NoTimeout)


def rates_stream(frames: DataFrame, period: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Frames a second of each camera and period of a stream; frames later than the watermark are left out."""
    seconds = pd.Timedelta(period).total_seconds()
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("camera_id", F.window("ts", period).alias("w")).agg((F.count(F.lit(1)) / seconds).alias("fps")).select("camera_id", F.col("w.start").alias("start"), "fps")


def frames_with_imu(frames: DataFrame, readings: DataFrame, before: str = "100 milliseconds", late: str = "30 seconds") -> DataFrame:
    """Each frame (frame_id, camera_id, ts) with the readings (sensor_id, at, ...) of the interval before it: a join of two streams, or of two tables.

    For tables the join key includes the interval's number, of which a frame takes two, so a busy sensor's readings spread."""
    if not frames.isStreaming and not readings.isStreaming:
        span = int(pd.Timedelta(before).total_seconds() * 1e6)
        slot = lambda c: F.floor(F.unix_micros(c) / span)
        f = frames.withColumns({"sensor_id": F.col("camera_id"), "slot": F.explode(F.array(slot("ts"), slot("ts") - 1))})
        pairs = f.join(readings.withColumn("slot", slot("at")), ["sensor_id", "slot"]).drop("slot")
        return pairs.where(F.expr(f"at <= ts and at > ts - interval {before}"))
    f, r = frames.withWatermark("ts", late), readings.withWatermark("at", late)
    return f.join(r, F.expr(f"sensor_id = camera_id and at <= ts and at > ts - interval {before}"))
