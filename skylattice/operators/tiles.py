"""Map tiles: zoom tables, tile keys, pyramids, and which tiles to keep at hand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.operators import mosaic
from skylattice.functions.geo import MAX_ZOOM, ORIGIN_SHIFT, TILE


def zoom_table(spark: SparkSession, zooms: int = MAX_ZOOM + 1) -> DataFrame:
    """zoom, n_tiles (a side) and resolution at the equator of every zoom."""
    return spark.range(zooms).select(F.col("id").cast("int").alias("zoom"), F.expr("power(2e0, id)").alias("n_tiles"), F.expr(f"{2 * ORIGIN_SHIFT / TILE!r} / power(2e0, id)").alias("resolution"))


def zoom_for_gsd(df: DataFrame, gsd: str, upscale: bool = True) -> DataFrame:
    """zoom of the first resolution that is finer than a ground sampling distance by 0.01 m, or the one before it."""
    levels = F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(2 * ORIGIN_SHIFT / TILE / 2.0**z).alias("resolution")) for z in range(MAX_ZOOM + 1)])
    fits = F.filter(levels, lambda s: F.col(gsd) >= s["resolution"] + 0.01)
    first = F.get(fits, F.lit(0))["zoom"]
    return df.withColumn("zoom", F.coalesce(first if upscale else F.greatest(first - 1, F.lit(0)), F.lit(MAX_ZOOM)))


def keyed(points: DataFrame, mx: str, my: str, zoom: int) -> DataFrame:
    """Pixel (px, py) and tile (tx, ty, counted from the south-west) of web-Mercator positions."""
    z = str(zoom)
    on = points.withColumns({"px": F.expr(geo.meters_to_pixels(mx, z)), "py": F.expr(geo.meters_to_pixels(my, z))})
    return on.withColumns({"tx": F.expr(geo.pixel_tile("px")), "ty": F.expr(geo.pixel_tile("py"))})


def pyramid(points: DataFrame, zmin: int, zmax: int, value: str = "z") -> DataFrame:
    """zoom, tx, ty, px, py and the mean value of every pixel from zmax down to zmin (mx, my: web-Mercator metres).

    Each level is made from the sums of the one below it, so all of them together are a third more rows than the finest."""
    if zmin > zmax:
        raise ValueError("zmin is above zmax")
    level = keyed(points, "mx", "my", zmax).groupBy("px", "py").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    levels = level.withColumn("zoom", F.lit(zmax))
    for zoom in range(zmax - 1, zmin - 1, -1):
        level = level.groupBy(*[F.floor(F.col(c) / 2).alias(c) for c in ("px", "py")]).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        levels = levels.unionByName(level.withColumn("zoom", F.lit(zoom)))
    return levels.select("zoom", F.expr(geo.pixel_tile("px")).alias("tx"), F.expr(geo.pixel_tile("py")).alias("ty"), "px", "py", (F.col("total") / F.col("n")).alias(value), "n")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """The tile table, laid out so that a tile's read touches one folder."""
    tiles.repartition("zoom", "tx").sortWithinPartitions("ty", "py", "px").write.mode("overwrite").partitionBy("zoom", "tx").parquet(path)


#: Columns that name a pixel of a tile table.
PIXEL = ["zoom", "tx", "ty", "px", "py"]


def read_tiles(spark: SparkSession, path: str, zoom: int | None = None, tx: tuple[int, int] | None = None, ty: tuple[int, int] | None = None) -> DataFrame:
    """Written tiles of a zoom and of ranges of tile numbers, ends included; only the folders of these are read."""
    tiles = spark.read.parquet(path)
    if zoom is not None:
        tiles = tiles.where(F.col("zoom") == zoom)
    for c, span in (("tx", tx), ("ty", ty)):
        if span is not None:
            tiles = tiles.where(F.col(c).between(*span))
    return tiles


def lookup(tiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pixels of the tiles (zoom, tx, ty) that are wanted."""
    return tiles.join(wanted.select("zoom", "tx", "ty").distinct(), ["zoom", "tx", "ty"], "left_semi")


def update_tiles(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Blend new tiles (zoom, tx, ty, px, py, color, elevation, angle, elevated) into written ones: only the folders they touch are read and written.

    The blended folders are staged beside the table first, as they are made from it."""
    touched = new.select("zoom", "tx").distinct()
    cached = spark.read.parquet(path).join(touched, ["zoom", "tx"], "left_semi")
    staged = path.rstrip("/") + "-next"
    write_tiles(mosaic.blend_tiles(new, cached, PIXEL), staged)
    blended = spark.read.parquet(staged).repartition("zoom", "tx").sortWithinPartitions("ty", "py", "px")
    blended.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("zoom", "tx").parquet(path)


def tile_sizes(tiles: DataFrame, pixel_bytes: int) -> DataFrame:
    """zoom, tx, ty, n_pixels and n_bytes: what each tile takes."""
    return tiles.groupBy("zoom", "tx", "ty").agg(F.count(F.lit(1)).alias("n_pixels")).withColumn("n_bytes", F.col("n_pixels") * pixel_bytes)


def tile_meters(df: DataFrame, zoom: int) -> DataFrame:
    """df (tx, ty) with the web-Mercator rectangle x, y, width, height of each tile."""
    size = 2 * ORIGIN_SHIFT / 2.0**zoom
    return df.withColumns({"x": F.col("tx") * size - ORIGIN_SHIFT, "y": F.col("ty") * size - ORIGIN_SHIFT, "width": F.lit(size), "height": F.lit(size)})


def tile_bounds(df: DataFrame, zoom: int) -> DataFrame:
    """Tile rectangle (tx0, ty0, n_x, n_y) of a web-Mercator rectangle in columns x, y, width, height."""
    z = str(zoom)
    t = lambda e: F.expr(geo.pixel_tile(geo.meters_to_pixels(e, z)))
    with_ends = df.withColumns({"tx0": t("x"), "ty0": t("y"), "tx1": t("(x + width)"), "ty1": t("(y + height)")})
    return with_ends.withColumns({"n_x": F.col("tx1") - F.col("tx0") + 1, "n_y": F.col("ty1") - F.col("ty0") + 1}).drop("tx1", "ty1")


def predicted_rect(df: DataFrame, by: str, order: list[str], cols=("x", "y", "width", "height")) -> DataFrame:
    """Each rectangle moved on by its change since the one before it: where the next is expected."""
    w = W.partitionBy(by).orderBy(*order)
    return df.withColumns({f"next_{c}": F.coalesce(2 * F.col(c) - F.lag(c).over(w), F.col(c)) for c in cols})


def evicted(tiles: DataFrame, predicted: DataFrame) -> DataFrame:
    """Tiles (camera_id, tx, ty) outside the predicted rectangle (tx0..tx1, ty0..ty1, borders kept) of their camera."""
    inside = F.col("tx").between(F.col("tx0"), F.col("tx1")) & F.col("ty").between(F.col("ty0"), F.col("ty1"))
    return tiles.join(predicted, "camera_id").where(~inside).select("camera_id", "tx", "ty")


def warp_to_mercator(cells: DataFrame, res: float, zone: int, layer: str, out_res: float) -> DataFrame:
    """A UTM raster (gx, gy, layer) on a web-Mercator lattice: each output node takes the nearest cell.

    Every cell proposes itself to the output nodes it may be nearest to, and the nearest proposal wins."""
    steps = geo.utm_inverse("easting", "northing", str(zone))
    placed = geo.with_steps(cells.where(F.col(layer).isNotNull()).withColumns({"easting": F.col("gx") * res, "northing": F.col("gy") * res}), steps)
    mx = F.radians("longitude") * geo.AXIS
    my = F.lit(geo.AXIS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians("latitude") / 2))
    stretch = 1 / F.cos(F.radians("latitude"))  # metres on the map for a metre on the ground
    reach = F.ceil(res * stretch / out_res).cast("int")
    around = F.sequence(-reach, reach)
    placed = placed.withColumns({"mx": mx, "my": my, "reach": res * stretch})
    sent = placed.withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
    sent = sent.withColumns({"wx": F.round(F.col("mx") / out_res).cast("long") + F.col("ox"), "wy": F.round(F.col("my") / out_res).cast("long") + F.col("oy")})
    d = F.sqrt(F.pow(F.col("wx") * out_res - F.col("mx"), 2) + F.pow(F.col("wy") * out_res - F.col("my"), 2))
    best = F.min(F.struct(d.alias("d"), "gx", "gy", layer, "reach"))
    nearest = sent.groupBy("wx", "wy").agg(best.alias("b"))
    return nearest.where("b.d <= b.reach").select("wx", "wy", F.col(f"b.{layer}").alias(layer))
