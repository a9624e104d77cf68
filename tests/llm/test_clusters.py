import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import clusters
from skylattice.llm.common import table

SCHEMA = "vec_id long, embedding array<float>"


def compared(vectors):
    got = sorted(map(tuple, clusters.clustered(vectors).collect()), key=repr)
    assert got == sorted(brute.clusters([(r.vec_id, r.embedding) for r in vectors.collect()]), key=repr)
    return got


def test_clusters_of_embeddings(spark):
    assert len({r[1] for r in compared(table(spark, "/root/testdata/sf0.01", "embeddings"))}) > 1


def test_odd_vectors(spark):
    rng = random.Random(2)
    v = lambda s=1.0: [rng.gauss(0, s) for _ in range(64)]
    same = v()
    rows = [(i, v(0.1 + i % 5)) for i in range(60)] + [(100 + i, same) for i in range(200)] + [(7, v()), (7, same), (None, v()), (None, same)]
    bad = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 63 + [None]), (304, [1.0] * 63 + [float("nan")]), (305, [1.0] * 63 + [float("-inf")])]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumns({"q": F.lit(1), "cluster": F.lit("x"), "key": F.lit(0)})
    assert len(compared(df)) == len(rows)
    compared(spark.createDataFrame(rows[:5], SCHEMA))
    assert clusters.clustered(spark.createDataFrame(bad, SCHEMA)).count() == 0 and clusters.clustered(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="too large"):
        clusters.clustered(spark.createDataFrame([(1, [3e8] * 64)], SCHEMA)).count()


def test_annulus_search_finds_the_first_of_the_nearest():
    rng = np.random.default_rng(1)
    for dim, k, n in ((2, 40, 500), (64, 16, 300), (1, 9, 100), (3, 1, 20)):
        q, c = rng.integers(-9, 10, (n, dim)), rng.integers(-9, 10, (k, dim))
        d = ((q[:, None] - c[None]) ** 2).sum(2)
        best, distance = clusters.nearest(q, c)
        assert (best == d.argmin(1)).all() and (distance == d.min(1)).all()
