"""Text sources and sinks: TUM trajectories, xyz points, camera files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.camera import Pinhole
from skylattice.operators.export import quaternion_rotation

TUM = "ts long, x double, y double, z double, qx double, qy double, qz double, qw double"


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """ts, x, y, z and rotation r00..r22 of a trajectory file; of lines with one ts the last in the file counts."""
    rows = spark.read.schema(TUM).csv(path, sep=" ", comment="#").dropna()
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    last = rows.groupBy("ts").agg(F.max_by(F.struct("x", "y", "z", "qx", "qy", "qz", "qw"), "nth").alias("p")).select("ts", "p.*")
    r = quaternion_rotation("qx", "qy", "qz", "qw")
    return last.select("ts", "x", "y", "z", *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])


def rotation_quaternion(r: list[list]) -> list:
    """Unit quaternion (x, y, z, w) of a rotation matrix of Columns; the largest component is found first."""
    trace = r[0][0] + r[1][1] + r[2][2]
    half = lambda a: F.sqrt(F.greatest(F.lit(0.0), a)) / 2
    size = [half(1 + r[0][0] - r[1][1] - r[2][2]), half(1 - r[0][0] + r[1][1] - r[2][2]), half(1 - r[0][0] - r[1][1] + r[2][2]), half(1 + trace)]
    sums = {(0, 1): r[0][1] + r[1][0], (0, 2): r[0][2] + r[2][0], (1, 2): r[1][2] + r[2][1], (0, 3): r[2][1] - r[1][2], (1, 3): r[0][2] - r[2][0], (2, 3): r[1][0] - r[0][1]}
    top = F.greatest(*size)
    def part(i):
        picks = F.when(size[i] >= top, size[i])
        for k in range(4):
            if k != i:
                picks = picks.when(size[k] >= top, sums[min(i, k), max(i, k)] / (4 * size[k]))
        return picks
    return [part(i) for i in range(4)]


def write_tum(poses: DataFrame, path: str) -> None:
    """Append poses (ts, x, y, z, r00..r22) as lines "ts x y z qx qy qz qw"."""
    q = rotation_quaternion([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    number = lambda c: F.format_string("%.10g", c)
    line = F.concat_ws(" ", F.col("ts").cast("string"), *[number(c) for c in (F.col("x"), F.col("y"), F.col("z"), *q)])
    poses.sortWithinPartitions("ts").select(line.alias("value")).write.mode("append").text(path)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Points of lines "x y z"; lines without three numbers are left out."""
    return spark.read.schema("x double, y double, z double").csv(path, sep=" ").dropna()


_SCALAR = re.compile(r"^\s*(\w+)\s*:\s*\"?([^\"\n\[{]+?)\"?\s*$", re.M)


def read_yaml(text: str) -> dict[str, str]:
    """The plain key: value lines of a YAML text."""
    return dict(_SCALAR.findall(text))


def read_camera(spark: SparkSession, path: str) -> Pinhole:
    """The pinhole camera of a YAML file; other kinds of camera are refused."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise FileNotFoundError(path)
    got = read_yaml(text[0])
    if got.get("type") != "pinhole":
        raise ValueError(f"unsupported camera type {got.get('type')!r}")
    number = lambda k: float(got.get(k, 0.0))
    return Pinhole(number("fx"), number("fy"), number("cx"), number("cy"), int(number("width")), int(number("height")), number("k1"), number("k2"), number("p1"), number("p2"), number("k3"))


def read_matrix(text: str, key: str) -> list[list[float]]:
    """A matrix of a YAML text: rows, cols and data under a key."""
    found = re.search(rf"{key}\s*:.*?rows\s*:\s*(\d+).*?cols\s*:\s*(\d+).*?data\s*:\s*\[([^\]]*)\]", text, re.S)
    if not found:
        raise ValueError(f"no matrix {key!r}")
    rows, cols, data = int(found[1]), int(found[2]), [float(x) for x in found[3].split(",")]
    if len(data) != rows * cols:
        raise ValueError(f"matrix {key!r} has {len(data)} numbers")
    return [data[i * cols : (i + 1) * cols] for i in range(rows)]


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("nth_last", nth).where("nth_last = 1").drop("nth_last")
