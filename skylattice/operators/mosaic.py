"""Mosaic and tile aggregation: the best observation of each cell wins.

The sequential fold over frames is an argmax: an observation replaces a cell's content if its
angle is strictly greater, so the earliest observation of the greatest angle stays. An observation
that beats all before it also beats those before it in any part of the cell's observations, so a
cell's observations are dealt over parts first, and only the few that rise within a part go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["gx", "gy"]


#: Parts that a cell's observations are dealt over.
PARTS = 16


def rising(observations: DataFrame, *by: str) -> DataFrame:
    """The observations whose angle is greater than all earlier ones (by seq) of their group."""
    before = F.max("angle").over(W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return observations.withColumn("beaten", before).where(F.col("beaten").isNull() | (F.col("angle") > F.col("beaten"))).drop("beaten")


def blend(observations: DataFrame) -> DataFrame:
    """gx, gy, color, elevation, angle and n_obs of the mosaic of (seq, gx, gy, color, elevation, angle).

    n_obs counts how often a cell's greatest angle was beaten, the first observation included."""
    seen = observations.where((F.col("angle") > 0) & F.col("elevation").isNotNull()).select("seq", *KEY, "color", "elevation", "angle")
    dealt = seen.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(PARTS)))
    records = rising(rising(dealt, *KEY, "part"), *KEY)
    best = F.max_by(F.struct("color", "elevation"), "angle")
    return records.groupBy(*KEY).agg(best.alias("best"), F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n_obs")).select(*KEY, "best.color", "best.elevation", "angle", "n_obs")


def elevated(observations: DataFrame) -> DataFrame:
    """The flag of each cell: set as soon as one observation sets it."""
    return observations.groupBy(*KEY).agg(F.max("elevated").alias("elevated"))


def first_valid(observations: DataFrame, layer: str = "elevation") -> DataFrame:
    """The earliest value of a layer in each cell that isn't empty."""
    there = observations.where(F.col(layer).isNotNull())
    return there.groupBy(*KEY).agg(F.min_by(layer, "seq").alias(layer))


def blend_tiles(new: DataFrame, cached: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Cells of two versions of a tile; the cached one stays if it is valid, seen at no smaller angle, and not flat where the new one is raised.

    elevated is 0 for reconstructed cells and 255 for flat ones."""
    key = key or KEY
    n = new.select(*key, F.struct("color", "elevation", "angle", "elevated").alias("n"))
    o = cached.select(*key, F.struct("color", "elevation", "angle", "elevated").alias("o"))
    beaten = (F.col("o.angle") < F.col("n.angle")) | ((F.col("o.elevated") > 0) & (F.col("n.elevated") == 0))
    keep = F.col("o.elevation").isNotNull() & (F.col("n").isNull() | ~F.coalesce(beaten, F.lit(False)))
    chosen = F.when(keep, F.col("o")).otherwise(F.coalesce("n", "o"))
    return n.join(o, key, "full_outer").select(*key, chosen.alias("c")).select(*key, "c.color", "c.elevation", "c.angle", "c.elevated")


def merge_latest(observations: DataFrame) -> DataFrame:
    """The newest value of each layer that isn't empty; a flag is empty at 0."""
    flag = F.when(F.col("elevated") > 0, F.col("elevated"))
    return observations.groupBy(*KEY).agg(
        F.max_by("elevation", F.when(F.col("elevation").isNotNull(), F.col("seq"))).alias("elevation"),
        F.max_by(flag, F.when(flag.isNotNull(), F.col("seq"))).alias("elevated"),
    )


def last_write(observations: DataFrame) -> DataFrame:
    """The newest observation of each cell as it is."""
    last = F.max_by(F.struct("color", "elevation", "angle"), "seq")
    return observations.groupBy(*KEY).agg(last.alias("c")).select(*KEY, "c.color", "c.elevation", "c.angle")
