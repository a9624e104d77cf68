"""The incremental tile pyramid against one that is made at once."""

import pytest
from pyspark.sql import functions as F

from skylattice.streaming import pyramid as P


def observations(spark, n, at, seed):
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 20))
    return spark.range(n).select(
        (F.col("id") + seed * 100_000).alias("seq"), (at[0] + h(0) % at[2]).cast("long").alias("px"), (at[1] + h(1) % at[2]).cast("long").alias("py"), (h(2) % 90 - 5).cast("double").alias("angle"), (h(3) / 7).alias("color"),
    )


def rows(df):
    return {tuple(r)[:5]: round(r.color, 6) for r in df.collect()}


def whole(state):
    out = {}
    for zoom in range(state.zmin, state.zmax + 1):
        tiles = state.tiles(zoom)
        out |= {(zoom, r.tx, r.ty, r.px, r.py): round(r.color, 6) for r in tiles.collect()} if tiles is not None else {}
    return out


BATCHES = [(400, (0, 0, 1500)), (100, (1400, 200, 300)), (50, (5000, 5000, 10)), (30, (0, 0, 20)), (0, (0, 0, 1))]


def test_every_batch_leaves_what_a_rebuild_gives(spark, tmp_path):
    state = P.TilePyramid(spark, str(tmp_path / "tiles"), 6, 8)
    assert whole(state) == {}
    every = None
    for k, (n, at) in enumerate(BATCHES):
        batch = observations(spark, n, at, k)
        before = set(p.name for p in (tmp_path / "tiles").glob("*-*")) if k else set()
        state.merge(batch, k)
        every = batch if every is None else every.unionByName(batch)
        assert whole(state) == rows(P.rebuilt(every, 6, 8))
        new = [p for p in (tmp_path / "tiles").glob("*-*") if p.name not in before]
        if n:  # what is written are the tiles that the batch touches and their parents
            seen = batch.where("angle > 0").select(F.shiftright("px", 8).alias("x"), F.shiftright("py", 8).alias("y")).distinct().collect()
            want = {(8 - z, x >> z, y >> z) for x, y in map(tuple, seen) for z in range(3)}
            got = {tuple(r) for r in spark.read.parquet(str(new[0])).select("zoom", "tx", "ty").distinct().collect()}
            assert len(new) == 1 and got == want
        else:
            assert not new
    state.merge(observations(spark, *BATCHES[1], 1), 1)  # again
    assert whole(state) == rows(P.rebuilt(every, 6, 8))
    state.gather()
    state.vacuum()
    assert len(list((tmp_path / "tiles").glob("*-*"))) == 1 and whole(state) == rows(P.rebuilt(every, 6, 8))


def test_a_failed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    state = P.TilePyramid(spark, str(tmp_path / "tiles"), 6, 8)
    first, second = observations(spark, 100, (0, 0, 600), 1), observations(spark, 100, (0, 0, 600), 2)
    state.merge(first, 0)
    held = whole(state)

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(P.TilePyramid, "_publish", broken)
    with pytest.raises(OSError):
        state.merge(second, 1)
    assert whole(state) == held
    monkeypatch.undo()
    state.merge(second, 1)
    assert whole(state) == rows(P.rebuilt(first.unionByName(second), 6, 8))
    state.vacuum()
    assert len(list((tmp_path / "tiles").glob("batch-*"))) == 1
    with pytest.raises(ValueError):
        P.TilePyramid(spark, str(tmp_path), 3, 2)


def test_streamed_pyramid(spark, tmp_path):
    obs = observations(spark, 300, (100, 100, 900), 5)
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    state = P.TilePyramid(spark, str(tmp_path / "tiles"), 6, 8)
    stream = lambda: spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    P.stream_pyramid(stream(), state, str(tmp_path / "ck")).awaitTermination()
    more = observations(spark, 100, (0, 0, 300), 6)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    P.stream_pyramid(stream(), state, str(tmp_path / "ck")).awaitTermination()
    assert whole(state) == rows(P.rebuilt(obs.unionByName(more), 6, 8))
