"""Exact order statistics of groups of any size, with bounded state.

A group's range is cut into BINS equal parts and counted; the part that holds the wanted rank is cut again, ROUNDS times, and
what is left, the rows of a very narrow range, is counted by value. Which part a value falls in only grows with the value,
so ranks stay exact whatever the values are; a group is a row of counts a part, and never a list of its values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a range, and how often it is cut.
BINS, ROUNDS = 1024, 2


def _matched(rows: DataFrame, table: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """rows with the columns of their group's row in a table; null groups are groups."""
    if not by:
        return rows.join(F.broadcast(table), F.lit(True), how)  # one row
    on = F.lit(True)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return rows.join(table.withColumnsRenamed({c: f"of_{c}" for c in by}), on, how).drop(*[f"of_{c}" for c in by])


def ranked_value(df: DataFrame, value: str, by: tuple[str, ...], rank: Callable[[Column], Column], name: str) -> DataFrame:
    """by and name: the value that has a rank (from 1 on, given the number of values) among those of its group that are there, in ascending order; groups without values are left out."""
    cells = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("sel_v"))
    wanted = cells.groupBy(*by).agg(F.min("sel_v").alias("sel_lo"), F.max("sel_v").alias("sel_hi"), rank(F.count(F.lit(1))).alias("sel_k"))

    def reached(counts: DataFrame, order: str) -> DataFrame:
        upto = F.sum("sel_n").over(W.partitionBy(*by).orderBy(order))
        at = counts.withColumn("sel_upto", upto).where((F.col("sel_upto") >= F.col("sel_k")) & (F.col("sel_upto") - F.col("sel_n") < F.col("sel_k")))
        return at.withColumn("sel_k", F.col("sel_k") - F.col("sel_upto") + F.col("sel_n"))

    for _ in range(ROUNDS):
        wide = F.col("sel_hi") - F.col("sel_lo")
        part = F.when(wide > 0, F.least(F.lit(BINS - 1), F.floor((F.col("sel_v") - F.col("sel_lo")) / F.when(wide > 0, wide) * BINS))).otherwise(0)
        inside = _matched(cells, wanted, by).where("sel_v between sel_lo and sel_hi")
        counts = inside.groupBy(*by, part.alias("sel_part"), "sel_k").agg(F.count(F.lit(1)).alias("sel_n"), F.min("sel_v").alias("sel_lo"), F.max("sel_v").alias("sel_hi"))
        wanted = reached(counts, "sel_part").select(*by, "sel_lo", "sel_hi", "sel_k")
    left = _matched(cells, wanted, by).where("sel_v between sel_lo and sel_hi").groupBy(*by, "sel_v", "sel_k").agg(F.count(F.lit(1)).alias("sel_n"))
    return reached(left, "sel_v").select(*by, F.col("sel_v").alias(name))


def lower_median(df: DataFrame, value: str, by: tuple[str, ...] = (), name: str = "median") -> DataFrame:
    """The lower median of a group's values."""
    return ranked_value(df, value, by, lambda n: F.ceil(n / 2), name)


def upper_median(df: DataFrame, value: str, by: tuple[str, ...] = (), name: str = "median") -> DataFrame:
    """The upper median of a group's values."""
    return ranked_value(df, value, by, lambda n: F.floor(n / 2) + 1, name)


def with_group(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A table of groups with the columns of another, null where that lacks a group; null groups are groups."""
    return _matched(left, right, by, "left")
