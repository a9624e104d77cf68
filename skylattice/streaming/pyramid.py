"""A tile pyramid that grows by micro-batches and rewrites only the tiles that change.

The finest zoom keeps the best observation of each pixel (greatest angle, then earliest seq); a pixel of any other zoom is the
mean of the up to four pixels below it. A batch blends into the finest tiles that it touches, and from there each zoom
rebuilds the parents of tiles that were rebuilt, from their new children and the unchanged siblings. All zooms of a batch go to a folder
of its own and become valid together by one file added to the manifest, which names the folder that holds a
tile's newest version: a batch that fails before leaves the pyramid as it was, and one that comes again changes nothing.

Pixels px, py count from the world's south-west corner at their zoom; a tile has TILE x TILE of them, and its parent is (tx div 2, ty div 2).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels along a tile (a power of two), and batches whose folders are gathered into one.
TILE, GATHERED = 256, 50
_BITS = TILE.bit_length() - 1
KEY = ["tx", "ty"]


class TilePyramid:
    """path: a folder all executors share. Values of `layers` are kept."""

    def __init__(self, spark: SparkSession, path: str, zmin: int, zmax: int, layers: tuple[str, ...] = ("color",)) -> None:
        if zmin > zmax:
            raise ValueError("zmin is above zmax")
        self.spark, self.path, self.zmin, self.zmax, self.layers = spark, path, zmin, zmax, layers

    def manifest(self) -> DataFrame | None:
        """zoom, tx, ty and the folder of every tile's newest version."""
        try:
            return self.spark.read.parquet(f"{self.path}/manifest").groupBy("zoom", *KEY).agg(F.max_by("folder", "batch").alias("folder"))
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def tiles(self, zoom: int, wanted: DataFrame | None = None) -> DataFrame | None:
        """Pixels (tx, ty, px, py, layers; angle and seq at the finest zoom) of a zoom; wanted (tx, ty) limits them to some tiles."""
        current = self.manifest()
        if current is None:
            return None
        current = current.where(F.col("zoom") == zoom).drop("zoom")
        if wanted is not None:
            current = current.join(wanted, KEY, "left_semi")
        folders = [r[0] for r in current.select("folder").distinct().collect()]  # one a batch since the last gathering
        if not folders:
            return None
        named = [self.spark.read.parquet(f"{self.path}/{f}/zoom={zoom}").withColumn("folder", F.lit(f)) for f in folders]
        rows = named[0]
        for more in named[1:]:
            rows = rows.unionByName(more)
        return rows.join(current, [*KEY, "folder"], "left_semi").drop("folder")

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"tx": F.shiftright("px", _BITS), "ty": F.shiftright("py", _BITS)})

    def _write(self, rows: DataFrame, folder: str, zoom: int) -> DataFrame:
        path = f"{self.path}/{folder}/zoom={zoom}"
        rows.repartition(*KEY).sortWithinPartitions(*KEY, "py", "px").write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _publish(self, written: dict[int, DataFrame], folder: str, batch: float) -> None:
        rows = None
        for zoom, df in written.items():
            one = df.select(F.lit(zoom).alias("zoom"), *KEY).distinct()
            rows = one if rows is None else rows.unionByName(one)
        rows.withColumns({"folder": F.lit(folder), "batch": F.lit(batch)}).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch function: blend observations (seq, px, py, angle, layers) of the finest zoom."""
        seen = self._keyed(batch.where(F.col("angle") > 0).select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), *self.layers, "angle", "seq"))
        if seen.isEmpty():
            return
        folder = f"batch-{batch_id}-{uuid.uuid4().hex[:8]}"
        old = self.tiles(self.zmax, seen.select(*KEY).distinct())
        every = seen if old is None else seen.unionByName(old)
        content = [*self.layers, "angle", "seq"]
        best = every.groupBy(*KEY, "px", "py").agg(F.min_by(F.struct(*content), F.struct(-F.col("angle"), "seq")).alias("b"))
        written = {self.zmax: self._write(best.select(*KEY, "px", "py", *[F.col("b")[c].alias(c) for c in content]), folder, self.zmax)}
        for zoom in range(self.zmax - 1, self.zmin - 1, -1):
            fresh = written[zoom + 1].select(*KEY, "px", "py", *self.layers)
            changed = fresh.select(*KEY).distinct()
            up = lambda c: F.shiftright(c, 1)
            parents = changed.select(up("tx").alias("tx"), up("ty").alias("ty")).distinct()
            both = F.array(F.lit(0), F.lit(1))
            siblings = parents.withColumns({"i": F.explode(both)}).withColumn("j", F.explode(both)).select((F.col("tx") * 2 + F.col("i")).alias("tx"), (F.col("ty") * 2 + F.col("j")).alias("ty"))
            kept = self.tiles(zoom + 1, siblings.join(changed, KEY, "left_anti"))
            below = fresh if kept is None else fresh.unionByName(kept.select(*fresh.columns))
            means = below.groupBy(up("px").alias("px"), up("py").alias("py")).agg(*[F.avg(c).alias(c) for c in self.layers])
            written[zoom] = self._write(self._keyed(means).select(*KEY, "px", "py", *self.layers), folder, zoom)
        self._publish(written, folder, float(batch_id))
        if self.manifest().select("folder").distinct().count() > GATHERED:
            self.gather()

    def gather(self) -> None:
        """Put the newest version of every tile into one folder."""
        newest = self.spark.read.parquet(f"{self.path}/manifest").agg(F.max("batch")).first()[0]
        folder, written = f"gathered-{uuid.uuid4().hex[:8]}", {}
        for zoom in range(self.zmin, self.zmax + 1):
            rows = self.tiles(zoom)
            if rows is not None:
                written[zoom] = self._write(rows, folder, zoom)
        self._publish(written, folder, newest + 0.5)

    def vacuum(self) -> None:
        """Delete folders that hold no tile's newest version, and those of failed batches, once nothing reads them."""
        current = self.manifest()
        used = {r[0] for r in current.select("folder").distinct().collect()} if current is not None else set()
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith(("batch-", "gathered-")) and name not in used:
                fs.delete(status.getPath(), True)


def rebuilt(observations: DataFrame, zmin: int, zmax: int, layers: tuple[str, ...] = ("color",)) -> DataFrame:
    """zoom, tx, ty, px, py and layers of the whole pyramid of a table of observations, made at once."""
    best = observations.where(F.col("angle") > 0).groupBy("px", "py").agg(F.min_by(F.struct(*layers), F.struct(-F.col("angle"), "seq")).alias("b"))
    level = best.select("px", "py", *[F.col("b")[c].alias(c) for c in layers])
    out = level.withColumn("zoom", F.lit(zmax))
    for zoom in range(zmax - 1, zmin - 1, -1):
        level = level.groupBy(F.shiftright("px", 1).alias("px"), F.shiftright("py", 1).alias("py")).agg(*[F.avg(c).alias(c) for c in layers])
        out = out.unionByName(level.withColumn("zoom", F.lit(zoom)))
    return out.select("zoom", F.shiftright("px", _BITS).alias("tx"), F.shiftright("py", _BITS).alias("ty"), "px", "py", *layers)


def stream_pyramid(observations: DataFrame, pyramid: TilePyramid, checkpoint: str):
    """Start a query that merges a stream of observations into a pyramid; it ends when the source has nothing new."""
    return observations.writeStream.foreachBatch(pyramid.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
