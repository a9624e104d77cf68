"""Georeferences from merged moments against fits of all measurements, batch and streamed."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skylattice.operators import georef, georef_state
from skylattice.plans import catalog
from skylattice.streaming import pose


def track(spark, n=60, cameras=3):
    rng = random.Random(2)
    rows = []
    for c in range(cameras):
        for k in range(n):
            a = 0.1 * k + c
            turn = np.array([[math.cos(a), math.sin(a), 0], [math.sin(a), -math.cos(a), 0], [0, 0, -1]])
            at = np.array([12 * k + rng.uniform(-3, 3), 5 * math.sin(k / 4) * 20, 100 + rng.uniform(-2, 2)])
            seen = (at - [600, 20, 5]) / (3 + c) + np.array([rng.gauss(0, 0.02) for _ in range(3)])
            rows.append((c, k, *map(float, at), *map(float, seen), *map(float, turn.ravel()), *map(float, turn.ravel())))
    names = ["gx", "gy", "gz", "vx", "vy", "vz", *georef.GROT, *georef.VROT]
    return spark.createDataFrame(rows, "camera_id long, seq long, " + ", ".join(f"{c} double" for c in names))


def transforms(spark, cameras=3):
    return spark.createDataFrame([(c, [float(x) for x in (3 + c, 0, 0, 590, 0, 3 + c, 0, 15, 0, 0, 3 + c, 5, 0, 0, 0, 1)]) for c in range(cameras)], "camera_id long, t array<double>")


def by_camera(df):
    return {r.camera_id: np.array(r.t) for r in df.collect()}


def same(a, b, least=1e-9):
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=least, atol=1e-7) for k in a)


def test_moments_give_the_fit_of_all_measurements(spark):
    p, t = track(spark), transforms(spark)
    want = by_camera(georef.refined(p, t, 3.0))
    same(by_camera(georef_state.refined_by_moments(georef_state.pose_moments(p), t, 3.0)), want)
    parts = georef_state.pose_moments(p.where("seq < 20")).unionByName(georef_state.pose_moments(p.where("seq >= 20")))
    same(by_camera(georef_state.refined_by_moments(georef_state.merged_states(parts), t, 3.0)), want)
    assert georef_state.pose_moments(p.limit(0)).count() == 0
    a, b = ({r.camera_id: r.t for r in catalog.QUERIES[n](spark, "/root/testdata/sf0.001").collect()} for n in ("georef_by_moments", "georef_refine"))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=2e-4) for k in a)


def test_streamed_updates_are_refits(spark, tmp_path):
    """One measurement a batch: after each, the transform is that of a fit of all kept so far, started from the transform before."""
    p, least = track(spark, 30), 1.0
    report, kept, first = georef.georef_init(p.where("seq < 20"), least, 3)
    kept = kept.persist()
    states = georef_state.first_states(kept, first).persist()
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    pose.use_rocksdb(spark)
    try:
        for k in (20, 24):
            p.where(F.col("seq").between(k, k + 3)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got = georef_state.updated_stream(stream, states, least)
        got.writeStream.format("memory").queryName("georef").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    found = {(r.camera_id, r.seq): (r.n, np.array(r.t)) for r in spark.table("georef").collect()}
    rows, t, n = p.toPandas(), by_camera(first), {r.camera_id: r["count"] for r in kept.groupBy("camera_id").count().collect()}
    held = {c: kept.where(F.col("camera_id") == c).select("seq", *georef_state.VECTOR).toPandas() for c in t}
    for c in t:
        z, now = held[c].sort_values("seq")[georef_state.VECTOR].to_numpy(), t[c].reshape(4, 4)
        for seq in range(20, 28):
            new = rows[(rows.camera_id == c) & (rows.seq == seq)][georef_state.VECTOR].to_numpy()
            if not georef_state.counts(new[0], z[-1], least):
                assert (c, seq) not in found
                continue
            z = np.concatenate([z, new])
            now = georef_state.refitted(georef_state.moments(z), now, 3.0)
            assert found[c, seq][0] == len(z) and np.allclose(found[c, seq][1], now.ravel(), rtol=1e-9, atol=1e-7)
        assert len(z) > n[c] + 5


def test_a_try_without_more_unique_ones_is_given_up(spark):
    p = track(spark, 20)
    report = georef.georef_init(p, 1.0, 3)[0].collect()
    assert report and all(r.stands for r in report)
    tried = spark.createDataFrame([(report[0].camera_id, report[0].n_unique), (report[1].camera_id, report[1].n_unique - 1)], "camera_id long, n_unique long")
    again = {r.camera_id: r.stands for r in georef.georef_init(p, 1.0, 3, tried=tried)[0].collect()}
    assert again == {r.camera_id: r.camera_id != report[0].camera_id for r in report}
