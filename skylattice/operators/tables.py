"""Tables written between the rounds of an iterative operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="skylattice-"))
    return got


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and lost executors take nothing with them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.written_path = path
    return again


def dropped(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
