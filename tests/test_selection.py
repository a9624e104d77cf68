"""Order statistics against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import selection as S


def groups():
    rng = random.Random(4)
    return {
        "even": [rng.uniform(-1, 1) for _ in range(500)], "odd": [rng.uniform(0, 1e9) for _ in range(501)], "same": [7.5] * 300, None: [rng.gauss(0, 1) for _ in range(64)],
        "steep": [2.0 ** rng.randrange(-60, 60) for _ in range(700)], "few": [float(rng.randrange(3)) for _ in range(400)], "one": [-3.0], "two": [1.0, 2.0], "outlier": [rng.uniform(0, 1) for _ in range(300)] + [1e300, -1e300],
        "close": [1.0 + k * 2.0**-52 for k in range(200)],
    }


@pytest.mark.parametrize("bins", [1024, 3])
def test_ranks_are_those_of_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(S, "BINS", bins)
    data = groups()
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("even", None), ("empty", None)], "g string, v double").withColumn("median", F.lit(1))
    lower, upper = ({r.g: r.m for r in f(df, "v", ("g",), "m").collect()} for f in (S.lower_median, S.upper_median))
    tenth = {r.g: r.m for r in S.ranked_value(df, "v", ("g",), lambda n: F.ceil(n / 10), "m").collect()}
    for g, vs in data.items():
        vs = sorted(vs)
        assert (lower[g], upper[g], tenth[g]) == (vs[(len(vs) - 1) // 2], vs[len(vs) // 2], vs[-(-len(vs) // 10) - 1])
    assert "empty" not in lower and len(lower) == len(data)
    whole = sorted(v for vs in data.values() for v in vs)
    assert S.lower_median(df, "v").first().median == whole[(len(whole) - 1) // 2]
    plan = S.lower_median(df, "v", ("g",))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
