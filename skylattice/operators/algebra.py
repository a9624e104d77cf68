"""Raster algebra on cell tables: a row per lattice cell (gx, gy), a nullable column per layer.

Overlap is an equi-join, extension of a sparse map is free, and merging is an outer join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["gx", "gy"]


def layers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEY]


def crop(cells: DataFrame, gx0: int, gy0: int, gx1: int, gy1: int) -> DataFrame:
    """Cells of a window, borders included; the filter reaches the scan."""
    return cells.where(F.col("gx").between(gx0, gx1) & F.col("gy").between(gy0, gy1))


def crop_world(cells: DataFrame, x: float, y: float, width: float, height: float, res: float) -> DataFrame:
    """Cells whose centre lies in a world window."""
    return cells.where((F.col("gx") * F.lit(res)).between(x, x + width) & (F.col("gy") * F.lit(res)).between(y, y + height))


def matrix_index(cells: DataFrame) -> DataFrame:
    """row and col of every cell in the bounding box of the map, row 0 in the north."""
    box = cells.agg(F.min("gx").alias("gx0"), F.max("gy").alias("gy1"))  # one row
    return cells.crossJoin(F.broadcast(box)).select("*", (F.col("gy1") - F.col("gy")).alias("row"), (F.col("gx") - F.col("gx0")).alias("col")).drop("gx0", "gy1")


def dense(cells: DataFrame, gx0: int, gy0: int, gx1: int, gy1: int) -> DataFrame:
    """Every cell of a window, missing ones with empty layers."""
    spark = cells.sparkSession
    lattice = spark.range(gx0, gx1 + 1).withColumnRenamed("id", "gx").select("gx", F.explode(F.sequence(F.lit(gy0).cast("long"), F.lit(gy1).cast("long"))).alias("gy"))
    return lattice.join(cells, KEY, "left")


def _sides(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left = a.select(*KEY, F.struct(*layers(a)).alias("l"))
    right = b.select(*KEY, F.struct(*layers(b)).alias("r"))
    return left.join(right, KEY, how)


def _pick(a: DataFrame, b: DataFrame, rule) -> list[Column]:
    out = []
    for c in dict.fromkeys([*layers(a), *layers(b)]):
        x = F.col("l")[c] if c in a.columns else F.lit(None)
        y = F.col("r")[c] if c in b.columns else F.lit(None)
        out.append(rule(c, x, y).alias(c))
    return out


def overlap(a: DataFrame, b: DataFrame, res: tuple[float, float] | None = None) -> DataFrame:
    """Cells that both maps have: l_ and r_ columns of the layers; maps of two resolutions (res, or what the maps carry) are refused."""
    _one_resolution(a, b, res)
    left = a.select(*KEY, *[F.col(c).alias(f"l_{c}") for c in layers(a)])
    return left.join(b.select(*KEY, *[F.col(c).alias(f"r_{c}") for c in layers(b)]), KEY)


def upsert(a: DataFrame, b: DataFrame, extend: bool = False, res: tuple[float, float] | None = None) -> DataFrame:
    """b's layers written over a's, empty values too; extend keeps the cells that only b has. Maps of two resolutions (res, or what the maps carry) are refused."""
    _one_resolution(a, b, res)
    joined = _sides(a, b, "full_outer" if extend else "left")
    def rule(c, x, y):
        return F.when(F.col("r").isNotNull(), y).otherwise(x) if c in b.columns else x
    return joined.select(*KEY, *_pick(a, b, rule))


def fill(a: DataFrame, b: DataFrame, extend: bool = False, zero: tuple[str, ...] = (), res: tuple[float, float] | None = None) -> DataFrame:
    """a's layers, empty ones filled from b; layers in zero count 0 as empty and take values above 0. Maps of two resolutions (res, or what the maps carry) are refused."""
    _one_resolution(a, b, res)
    def rule(c, x, y):
        if c in zero:
            return F.when((F.coalesce(x, F.lit(0)) == 0) & (y > 0), y).otherwise(x)
        return F.coalesce(x, y)
    return _sides(a, b, "full_outer" if extend else "left").select(*KEY, *_pick(a, b, rule))


def resample_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """The map on a lattice factor times coarser: the cell on each coarser node."""
    on = (F.col("gx") % factor == 0) & (F.col("gy") % factor == 0)
    return _rescaled(cells.where(on).withColumn("gx", (F.col("gx") / factor).cast("long")).withColumn("gy", (F.col("gy") / factor).cast("long")), cells, factor)


def resample_area(cells: DataFrame, factor: int) -> DataFrame:
    """The map on a coarser lattice: means over the fine cells of each coarse one."""
    coarse = cells.select(F.floor(F.col("gx") / factor).alias("gx"), F.floor(F.col("gy") / factor).alias("gy"), *layers(cells))
    return _rescaled(coarse.groupBy(*KEY).agg(*[F.avg(c).alias(c) for c in layers(cells)]), cells, factor)


def refine_bilinear(cells: DataFrame, factor: int) -> DataFrame:
    """The map on a finer lattice by bilinear interpolation; only where all four neighbours are there.

    Each cell sends its weighted layers to the fine nodes around it, so the join of four neighbours is one aggregation."""
    near = F.sequence(F.lit(1 - factor), F.lit(factor - 1))
    spread = cells.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    weight = (1 - F.abs("dx") / factor) * (1 - F.abs("dy") / factor)
    part = spread.select((F.col("gx") * factor + F.col("dx")).alias("gx"), (F.col("gy") * factor + F.col("dy")).alias("gy"), weight.alias("w"), *layers(cells))
    sums = part.groupBy(*KEY).agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(c) for c in layers(cells)])
    return _rescaled(sums.where(F.col("w") > 1 - 1e-9).drop("w"), cells, 1 / factor)


def clamp_to(cells: DataFrame, layer: str, reference: DataFrame) -> DataFrame:
    """A layer's values outside the range of a reference map become empty."""
    span = reference.agg(F.min(layer).alias("lo"), F.max(layer).alias("hi"))  # one row
    return cells.crossJoin(F.broadcast(span)).withColumn(layer, F.when(F.col(layer).between(F.col("lo"), F.col("hi")), F.col(layer))).drop("lo", "hi")


def color_scale(cells: DataFrame, layer: str) -> DataFrame:
    """A layer's values scaled to 0..255 over their range; empty cells are 0."""
    span = cells.agg(F.min(layer).alias("lo"), F.max(layer).alias("hi"))  # one row
    wide = F.col("hi") - F.col("lo")
    level = F.when(F.col(layer).isNull() | (wide == 0), 0).otherwise(F.floor(255.0 * (F.col(layer) - F.col("lo")) / F.when(wide != 0, wide) + 0.5))
    return cells.crossJoin(F.broadcast(span)).select(*KEY, level.cast("int").alias("level"))


def with_resolution(cells: DataFrame, res: float) -> DataFrame:
    """The map with its resolution, which the column gx carries from now on."""
    return cells.withMetadata("gx", {**cells.schema["gx"].metadata, "resolution": float(res)})


def resolution_of(cells: DataFrame) -> float | None:
    """The resolution that a map carries."""
    return cells.schema["gx"].metadata.get("resolution")


def _one_resolution(a: DataFrame, b: DataFrame, res: tuple[float, float] | None) -> None:
    left, right = res or (resolution_of(a), resolution_of(b))
    if left is not None and right is not None:
        require_same_resolution(left, right)


def _rescaled(cells: DataFrame, of: DataFrame, factor: float) -> DataFrame:
    """cells, made of a map, with its resolution times a factor, if it carries one."""
    res = resolution_of(of)
    return cells if res is None else with_resolution(cells, res * factor)


def require_same_resolution(left: float, right: float) -> None:
    """Maps are only joined at one resolution; others are resampled first."""
    if abs(left - right) > 1e-9 * max(abs(left), abs(right)):
        raise ValueError(f"resolutions {left} and {right} differ")


def resample_to(cells: DataFrame, from_res: float, to_res: float, *layers: str) -> DataFrame:
    """Layers of a raster at another resolution: each new cell takes the value of the nearest old one."""
    ratio = from_res / to_res
    half = math.ceil(ratio / 2) + 1
    near = lambda c: F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.round(F.col(c) * ratio).cast("long") + k))
    sent = cells.select(F.col("gx").alias("ox"), F.col("gy").alias("oy"), *layers).withColumn("gx", near("ox")).withColumn("gy", near("oy"))
    own = (F.floor(F.col("gx") / ratio + 0.5) == F.col("ox")) & (F.floor(F.col("gy") / ratio + 0.5) == F.col("oy"))
    return with_resolution(sent.where(own).select("gx", "gy", *layers), to_res)


def jet(level: Column) -> list[Column]:
    """Red, green and blue (0..255) of a level 0..255 on the map from blue over green to red."""
    v = level / 255.0
    part = lambda peak: F.floor(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * v - peak))) + 0.5).cast("int")
    return [part(3.0), part(2.0), part(1.0)]


def normal_colors(nx: Column, ny: Column, nz: Column) -> list[Column]:
    """Red, green and blue (0..255) of the components -1..1 of a unit vector."""
    return [F.floor((c + 1) * 127.5 + 0.5).cast("int") for c in (nx, ny, nz)]


def resample(cells: DataFrame, from_res: float, to_res: float, methods: dict[str, str]) -> DataFrame:
    """Every layer at another resolution by its own method: nearest, or linear between the four cells around."""
    if unknown := set(methods.values()) - {"nearest", "linear"}:
        raise ValueError(f"no methods {sorted(unknown)}")
    plain = [c for c, m in methods.items() if m == "nearest"]
    out = resample_to(cells, from_res, to_res, *plain)
    smooth = [c for c, m in methods.items() if m == "linear"]
    if smooth:
        out = out.join(_linear(cells, from_res / to_res, smooth), KEY, "left")
    return out


def _linear(cells: DataFrame, ratio: float, names: list[str]) -> DataFrame:
    """Layers between the four cells around each new one; of those that are empty the others' weights make up."""
    reach = lambda c: F.explode(F.sequence(F.ceil((F.col(c) - 1) * ratio), F.floor((F.col(c) + 1) * ratio)))
    sent = cells.select(F.col("gx").alias("ox"), F.col("gy").alias("oy"), *names).withColumn("gx", reach("ox")).withColumn("gy", reach("oy"))
    near = lambda c, o: F.greatest(F.lit(0.0), 1 - F.abs(F.col(c) / ratio - F.col(o)))
    w = near("gx", "ox") * near("gy", "oy")
    part = lambda c: F.sum(F.when(F.col(c).isNotNull(), w * F.col(c))) / F.sum(F.when(F.col(c).isNotNull() & (w > 0), w))
    return sent.groupBy(*KEY).agg(*[part(c).alias(c) for c in names])
