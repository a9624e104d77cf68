"""Export tables: point clouds, meshes, overviews, raster metadata, name and text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cloud(cells: DataFrame, res: float) -> DataFrame:
    """A point for every cell with an elevation."""
    return cells.where(F.col("elevation").isNotNull()).select("gx", "gy", (F.col("gx") * res).alias("x"), (F.col("gy") * res).alias("y"), F.col("elevation").alias("z"), "color")


def mesh(cells: DataFrame) -> DataFrame:
    """Two triangles (half 0 and 1; corners a, b, c) for every lattice square whose four corners are there.

    Each cell stands for a corner of four squares, so full squares are found by one aggregation."""
    corner = lambda dx, dy: F.struct((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"))
    squares = cells.select(F.explode(F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)])).alias("s")).groupBy("s.gx", "s.gy").agg(F.count(F.lit(1)).alias("n")).where("n = 4")
    at = lambda dx, dy: F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy"))
    faces = F.array(
        F.struct(F.lit(0).alias("half"), at(0, 0).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("c")),
        F.struct(F.lit(1).alias("half"), at(1, 0).alias("a"), at(1, 1).alias("b"), at(0, 1).alias("c")),
    )
    return squares.select("gx", "gy", F.explode(faces).alias("f")).select("gx", "gy", "f.*")


def mesh_over_mask(cells: DataFrame) -> DataFrame:
    """mesh, and one triangle (half 2) for every lattice square that lacks one corner: the edge of a mask is followed, holes stay open."""
    corner = lambda dx, dy: F.struct((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.lit(2 * dy + dx).alias("k"))
    each = cells.select(F.explode(F.array(*[corner(dx, dy) for dx in (0, 1) for dy in (0, 1)])).alias("s"))
    squares = each.groupBy("s.gx", "s.gy").agg(F.sort_array(F.collect_set("s.k")).alias("k")).where(F.size("k") == 3)
    at = lambda i: F.struct((F.col("gx") + F.col("k")[i] % 2).alias("gx"), (F.col("gy") + F.floor(F.col("k")[i] / 2)).alias("gy"))
    turn = F.col("k")[1] == 2  # corners 0 2 3 and 1 2 3 run the other way round than 0 1 2 and 0 1 3
    b, c = F.when(turn, at(2)).otherwise(at(1)), F.when(turn, at(1)).otherwise(at(2))
    return mesh(cells).unionByName(squares.select("gx", "gy", F.lit(2).alias("half"), at(0).alias("a"), b.alias("b"), c.alias("c")))


def indexed_mesh(cells: DataFrame, faces: DataFrame, res: float, side: int = 256, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of meshes by squares of lattice cells: vertices mesh, id, x, y, z and the columns to keep, faces mesh, a, b, c by vertex id.

    Ids count from 0 within a mesh, so each mesh is a file of its own and no numbering spans the whole table."""
    name = F.concat_ws("_", F.floor(F.col("gx") / side).cast("string"), F.floor(F.col("gy") / side).cast("string"))
    own = faces.select(name.alias("mesh"), "gx", "gy", "half", "a", "b", "c")
    used = own.select("mesh", F.explode(F.array("a", "b", "c")).alias("v")).select("mesh", "v.gx", "v.gy").distinct()
    placed = used.join(cells.select("gx", "gy", "elevation", *keep), ["gx", "gy"])
    nth = (F.row_number().over(W.partitionBy("mesh").orderBy("gx", "gy")) - 1).cast("long")
    vertices = placed.select("mesh", nth.alias("id"), "gx", "gy", (F.col("gx") * res).alias("x"), (F.col("gy") * res).alias("y"), F.col("elevation").alias("z"), *keep)
    found = own
    for k in ("a", "b", "c"):
        ids = vertices.select("mesh", F.struct("gx", "gy").alias(k), F.col("id").alias(f"id_{k}"))
        found = found.join(ids, ["mesh", k])
    return vertices.drop("gx", "gy"), found.select("mesh", *[F.col(f"id_{k}").alias(k) for k in ("a", "b", "c")])


def mesh_rows(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices and faces in one table (kind 0 and 1), as the data source plymesh writes them: a file for each mesh."""
    extra = [c for c in vertices.columns if c not in ("mesh", "id", "x", "y", "z")]
    points = vertices.select("mesh", F.lit(0).alias("kind"), "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", *extra)], *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "c")])
    sides = faces.select("mesh", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "z", *extra)], "a", "b", "c")
    return points.unionByName(sides).repartition("mesh").sortWithinPartitions("mesh", "kind", "id", "a", "b", "c")


def depth_sidecars(depth: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id, least and greatest depth and the pose that a scaled depth map needs beside it."""
    span = depth.groupBy("frame_id").agg(F.min("depth").alias("min"), F.max("depth").alias("max"))
    return span.join(frames.select("frame_id", F.struct("easting", "northing", "altitude", "heading").alias("pose")), "frame_id")


def layer_sidecars(cells: DataFrame, res: float, zone: int, band: str, *by: str) -> DataFrame:
    """Rectangle, resolution, zone and band of the raster that the cells of each group span."""
    m = raster_metadata(cells, res, *by)
    low = F.col("y_top") - (F.col("rows") - 1) * res
    roi = F.struct(F.col("x0").alias("x"), low.alias("y"), ((F.col("cols") - 1) * res).alias("width"), ((F.col("rows") - 1) * res).alias("height"))
    return m.select(*by, roi.alias("roi"), F.lit(res).alias("resolution"), F.lit(zone).alias("zone"), F.lit(band).alias("band"), "rows", "cols")


def scene_lines(views: DataFrame, frames: DataFrame) -> DataFrame:
    """value: a scene as JSON lines, a line a camera and a line a point with the frames that see it; positions are relative to the first frame."""
    origin = frames.agg(F.min_by("easting", "frame_id").alias("ox"), F.min_by("northing", "frame_id").alias("oy"))
    cameras = frames.crossJoin(F.broadcast(origin)).select(
        F.to_json(F.struct(F.lit("camera").alias("kind"), "frame_id", (F.col("easting") - F.col("ox")).alias("x"), (F.col("northing") - F.col("oy")).alias("y"), F.col("altitude").alias("z"), "heading")).alias("value")
    )  # one row of origin
    moved = views.crossJoin(F.broadcast(origin))
    points = moved.select(F.to_json(F.struct(F.lit("point").alias("kind"), "point_id", (F.col("x") - F.col("ox")).alias("x"), (F.col("y") - F.col("oy")).alias("y"), "z", "views")).alias("value"))
    return cameras.unionByName(points)


def save_enabled(tables: dict[str, DataFrame], settings, path: str) -> list[str]:
    """Write each table whose setting save_<name> is on, to path/<name>; the names written."""
    on = [n for n in tables if getattr(settings, f"save_{n}", False)]
    for n in on:
        tables[n].write.mode("overwrite").parquet(f"{path}/{n}")
    return on


def overviews(cells: DataFrame, factors: tuple[int, ...]) -> DataFrame:
    """Nearest-sample reductions of a raster by each factor."""
    each = cells.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))
    on = each.where((F.col("gx") % F.col("factor") == 0) & (F.col("gy") % F.col("factor") == 0))
    return on.withColumns({c: F.floor(F.col(c) / F.col("factor")) for c in ("gx", "gy")})


def raster_metadata(cells: DataFrame, res: float, *by: str) -> DataFrame:
    """Origin, steps and size of the raster that the cells of each group span; its geotransform."""
    return cells.groupBy(*by).agg((F.min("gx") * res).alias("x0"), (F.max("gy") * res).alias("y_top"), (F.max("gx") - F.min("gx") + 1).alias("cols"), (F.max("gy") - F.min("gy") + 1).alias("rows")).select(
        *by, "x0", F.lit(res).alias("gsd"), "y_top", F.lit(-res).alias("step"), "cols", "rows"
    )


def vertex_views(observed: DataFrame) -> DataFrame:
    """point_id, z (the least) and the sorted views of every point."""
    return observed.groupBy("point_id").agg(F.min("z").alias("z"), F.sort_array(F.collect_set("view")).alias("views"))


def scaled_depth(depth: DataFrame) -> DataFrame:
    """Depths scaled to 0..65535 over their frame's range."""
    span = depth.groupBy("frame_id").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    wide = F.col("hi") - F.col("lo")
    level = F.floor((F.col("depth") - F.col("lo")) / F.when(wide != 0, wide) * 65535 + 0.5).cast("int")
    return depth.where(F.col("depth").isNotNull()).join(span, "frame_id").select("frame_id", "gx", "gy", level.alias("level"))


def file_name(prefix: str, number: Column, suffix: str) -> Column:
    """prefix_ and the number at six digits."""
    return F.concat(F.lit(prefix + "_"), F.lpad(number.cast("string"), 6, "0"), F.lit(suffix))


def frame_number(path: str) -> Column:
    """The number in the last four characters of a file's first name part."""
    return F.substring(F.substring_index(F.substring_index(F.col(path), "/", -1), ".", 1), -4, 4).cast("long")


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def quaternion_rotation(qx: str, qy: str, qz: str, qw: str) -> list[list[Column]]:
    """Rotation matrix of a unit quaternion."""
    x, y, z, w = (F.col(c) for c in (qx, qy, qz, qw))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def timing_report(lines: DataFrame) -> DataFrame:
    """n, mean, sample standard deviation, min and max of every step in log lines "Timing [step]: n ms"."""
    found = lines.select(F.regexp_extract("value", r"Timing \[(.*)\]: (\d+) ms", 1).alias("step"), F.regexp_extract("value", r"Timing \[(.*)\]: (\d+) ms", 2).alias("ms")).where("ms <> ''")
    ms = found.withColumn("ms", F.col("ms").cast("long"))
    return ms.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.stddev_samp("ms").alias("stdev"), F.min("ms").alias("min"), F.max("ms").alias("max"))
