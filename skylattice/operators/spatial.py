"""Spatial search and interpolation over point tables.

A range join is an equi-join on square buckets as wide as the radius, of which a query takes nine.
Where the queries are the nodes of a lattice no join is needed: each point reaches the nodes around
it by arithmetic, and what they gather are sums that combine before the shuffle.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def square(ax, ay, bx, by) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def radius_join(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of query (qx, qy, ...) and point (x, y, ...) with a squared distance d2 below radius squared."""
    offsets = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    cell = lambda c: F.floor(F.col(c) / radius)
    q = queries.withColumn("bx", F.explode(F.transform(offsets, lambda k: cell("qx") + k))).withColumn("by", F.explode(F.transform(offsets, lambda k: cell("qy") + k)))
    p = points.withColumn("bx", cell("x")).withColumn("by", cell("y"))
    pairs = p.join(q, ["bx", "by"]).drop("bx", "by").withColumn("d2", square(F.col("x"), F.col("y"), F.col("qx"), F.col("qy")))
    return pairs.where(F.col("d2") < radius * radius)


def nearest(queries: DataFrame, points: DataFrame, k: int, radius: float, id_column: str = "qid", order: tuple[str, ...] = (), least: float = -1.0) -> DataFrame:
    """The k nearest points of each query, exactly: searched within a radius that doubles for queries still short of k.

    Points at a squared distance of least or nearer are passed over; ties are broken by the order columns."""
    total = points.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not total[0]:
        return radius_join(queries, points, radius).withColumn("rank", F.lit(0))
    spread = queries.agg(F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).first()
    far = math.hypot(*(max(total[2 + 2 * i], spread[1 + 2 * i] or 0) - min(total[1 + 2 * i], spread[2 * i] or 0) for i in (0, 1))) + 1.0
    by = W.partitionBy(id_column).orderBy("d2", *order)
    out, left = None, queries
    while True:
        near = radius_join(left, points, radius).where(F.col("d2") > least).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        near = near.persist()  # read for the answers and for what is left, in this round and the next
        full = near.where(F.col("rank") == k).select(id_column)
        last = radius > far
        done = near if last else near.join(full, id_column, "left_semi")
        out = done if out is None else out.unionByName(done)
        left = left.join(full, id_column, "left_anti")
        if last or left.isEmpty():
            return out
        radius *= 2


def furthest(pairs: DataFrame, k: int, id_column: str = "qid", order: tuple[str, ...] = ()) -> DataFrame:
    """The k furthest of each query's neighbours."""
    by = W.partitionBy(id_column).orderBy(F.col("d2").desc(), *order)
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def near_nodes(points: DataFrame, res: float, radius: float, gx0: int, gy0: int, gx1: int, gy1: int) -> DataFrame:
    """Every point with the lattice nodes (gx, gy) of a window within a radius, and d2."""
    def reach(c: str, lo: int, hi: int):
        first, last = F.ceil((F.col(c) - radius) / res), F.floor((F.col(c) + radius) / res)
        first, last = F.greatest(first, F.lit(lo).cast("long")), F.least(last, F.lit(hi).cast("long"))
        return F.when(first <= last, F.sequence(first, last))
    on = points.withColumn("gx", F.explode(reach("x", gx0, gx1))).withColumn("gy", F.explode(reach("y", gy0, gy1)))
    return on.withColumn("d2", square(F.col("x"), F.col("y"), F.col("gx") * res, F.col("gy") * res)).where(F.col("d2") < radius * radius)


def idw_surface(points: DataFrame, res: float, rounds: int, window: tuple[int, int, int, int], values: tuple[str, ...] = ("z",), by: tuple[str, ...] = (), rings: bool = False) -> DataFrame:
    """Inverse-distance means of values at lattice nodes, over the first ring that holds three points.

    Ring i holds the points with d2 < i * res; a node with fewer than three points in ring rounds - 1 stays empty. A
    point on the node gives its value. Points are summed by ring before the shuffle, so a node's row is one per ring.
    by names columns of several clouds in one table; rings adds the ring that was used."""
    reach, key = math.sqrt((rounds - 1) * res), [*by, "gx", "gy"]
    near = near_nodes(points, res, reach, *window).withColumn("ring", (F.floor(F.col("d2") / res) + 1).cast("int"))
    off = F.when(F.col("d2") > 0, F.col("d2"))
    summed = near.groupBy(*key, "ring").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 / off).alias("w"), *[F.sum(F.col(v) / off).alias(f"s_{v}") for v in values],
        *[F.avg(F.when(F.col("d2") == 0, F.col(v))).alias(f"hit_{v}") for v in values],
    )
    upto = W.partitionBy(*key).orderBy("ring")
    sums = summed.select(
        *key, "ring", F.sum("n").over(upto).alias("n"), F.sum("w").over(upto).alias("w"),
        *[F.sum(f"s_{v}").over(upto).alias(f"s_{v}") for v in values], *[F.max(f"hit_{v}").over(upto).alias(f"hit_{v}") for v in values],
    ).where((F.col("n") >= 3) & (F.col("ring") < rounds))
    first = sums.groupBy(*key).agg(F.min_by(F.struct("w", *[f"s_{v}" for v in values], *[f"hit_{v}" for v in values]), "ring").alias("r"), F.min("ring").alias("ring"))
    return first.select(*key, *[F.coalesce(F.col(f"r.hit_{v}"), F.col(f"r.s_{v}") / F.col("r.w")).alias(v) for v in values], *(["ring"] if rings else []))


def normalised(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """A vector in three columns at length 1; NULL for none."""
    length = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    return df.withColumn("vector_length", F.when(length > 0, length)).withColumns({c: F.col(c) / F.col("vector_length") for c in (x, y, z)}).drop("vector_length")


def plane_of_three(p: tuple, q: tuple, r: tuple) -> tuple[Column, Column, Column]:
    """Unit normal, upwards, of the plane through three points (each three Columns)."""
    u, v = [q[i] - p[i] for i in range(3)], [r[i] - p[i] for i in range(3)]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    sign = F.when(n[2] < 0, -1.0).otherwise(1.0)
    return tuple(sign * c / F.when(length > 0, length) for c in n)


MOMENTS = ("n", "mx", "my", "mz", "cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def plane_moments(points: DataFrame, *by: str) -> DataFrame:
    """Number, centroid and covariance of the points of each group: what a plane fit needs."""
    c = lambda a, b: F.covar_pop(a, b).alias(f"c{a}{b}")
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), c("x", "x"), c("x", "y"), c("x", "z"), c("y", "y"), c("y", "z"), c("z", "z"))


def fit_planes(moments: DataFrame) -> DataFrame:
    """Upward unit normal (nx, ny, nz) of the best plane of each row of plane_moments."""
    import numpy as np

    @F.pandas_udf("nx double, ny double, nz double")
    def normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).astype(float).reshape(-1, 3, 3)
        n = np.linalg.eigh(m)[1][:, :, 0]
        n = np.where(n[:, 2:] < 0, -n, n)
        return pd.DataFrame(n, columns=["nx", "ny", "nz"])

    return moments.withColumn("plane", normal("cxx", "cxy", "cxz", "cyy", "cyz", "czz")).select("*", "plane.*").drop("plane")


def ground_sampling_distance(points: DataFrame, every: int, radius: float = 1.0) -> DataFrame:
    """n and gsd: root mean square distance to the nearest other place, over places picked by a hash, one in every.

    Points nearer than 1e-4 (squared) count as the same place."""
    places = points.select("x", "y").distinct()
    picked = places.where(F.pmod(F.xxhash64("x", "y"), F.lit(every)) == 0).select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.struct("x", "y").alias("qid"))
    near = nearest(picked, places, 1, radius, least=1e-4)
    return near.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("d2")).alias("gsd"))


#: Side of the squares of cells that smoothing deals out.
SQUARE = 64


def smooth(cells: DataFrame, layer: str, size: int = 5, kind: str = "median", sigma_value: float = 25.0, sigma_space: float = 25.0, by: tuple[str, ...] = ()) -> DataFrame:
    """A layer filtered over its neighbours (those that are there): the median of a size x size square, or bilateral over the disc in it.

    Squares of cells are dealt out, each with a border of its neighbours' cells, and the stencil stays within them. A
    table of several lattices names in by the columns that tell them apart; cells of different ones are no neighbours."""
    if kind not in ("median", "bilateral"):
        raise ValueError(f"no filter {kind}")
    half = size // 2
    around = F.sequence(F.lit(-half), F.lit(half))
    there = cells.where(F.col(layer).isNotNull()).select(*by, "gx", "gy", F.col(layer).alias("v"))
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / SQUARE), F.floor((F.col(c) + half) / SQUARE)))
    dealt = there.withColumn("bx", near("gx")).withColumn("by", near("gy")).repartition(*by, "bx", "by")
    sent = dealt.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")})
    sent = sent.where((F.floor(F.col("gx") / SQUARE) == F.col("bx")) & (F.floor(F.col("gy") / SQUARE) == F.col("by")))
    if kind == "bilateral":
        sent = sent.where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= half * half)
    got = sent.groupBy(*by, "bx", "by", "gx", "gy").agg(
        F.sort_array(F.collect_list(F.struct("v", "dx", "dy"))).alias("near"), F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("v"))).alias("own")
    ).where(F.col("own").isNotNull())
    n, own = F.size("near"), F.col("own")
    if kind == "median":
        value = (F.get("near", F.floor((n - 1) / 2).cast("int"))["v"] + F.get("near", F.floor(n / 2).cast("int"))["v"]) / 2
    else:
        weight = lambda s: F.exp(-(s["dx"] * s["dx"] + s["dy"] * s["dy"]) / (2 * sigma_space**2) - (s["v"] - own) * (s["v"] - own) / (2 * sigma_value**2))
        zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("t"))
        sums = F.aggregate("near", zero, lambda a, s: F.struct((a["w"] + weight(s)).alias("w"), (a["t"] + weight(s) * s["v"]).alias("t")))
        got, value = got.withColumn("sums", sums), F.col("sums.t") / F.col("sums.w")
    got = got.select(*by, "gx", "gy", value.alias("smooth"))
    return cells.join(got, [*by, "gx", "gy"], "left").withColumn(layer, F.when(F.col(layer).isNotNull(), F.col("smooth"))).drop("smooth")
