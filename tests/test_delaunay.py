"""Triangulations against their definition, and those of many blocks against that of one."""

import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import delaunay as D


def hull_area(points):
    """Twice the area of the convex hull."""
    points, chain = sorted(points), []
    for way in (points, points[::-1]):
        part = []
        for p in way:
            while len(part) > 1 and D._turn(part[-2], part[-1], p) <= 0:
                part.pop()
            part.append(p)
        chain += part[:-1]
    return sum(chain[i - 1][0] * chain[i][1] - chain[i][0] * chain[i - 1][1] for i in range(len(chain)))


@pytest.mark.parametrize("seed", range(60))
def test_circles_are_empty_and_the_hull_is_filled(seed):
    rng = random.Random(seed)
    wide = rng.choice([3, 6, 12, 40])
    points = sorted({(rng.randrange(wide), rng.randrange(wide)) for _ in range(rng.randrange(3, 60))})
    found = [tuple(points[i] for i in t) for t in D.triangulate(points)]
    for a, b, c in found:
        assert D._turn(a, b, c) > 0
        assert not any(D.beyond(a, b, c, d) for d in points if d not in (a, b, c))
    assert sum(D._turn(*t) for t in found) == hull_area(points)


def masks():
    rng = random.Random(11)
    disc = [(x, y) for x in range(90) for y in range(90) if (x - 45) ** 2 + (y - 40) ** 2 < 1600 and not (x - 40) ** 2 + (y - 50) ** 2 < 300 and not 60 < x < 64]
    band = [(x, y) for x in range(-60, 80) for y in range(-70, 70) if abs(3 * x - 2 * y) < 60 and rng.random() < 0.8]
    return {
        "sparse": [(rng.randrange(150) - 40, rng.randrange(90) - 70) for _ in range(500)],
        "disc": disc,
        "band": band,
        "clusters": [(x + rng.randrange(9), y + rng.randrange(9)) for x, y in ((0, 0), (120, 3), (60, 100), (118, 97)) for _ in range(40)],
        "line": [(x, 2 * x) for x in range(30)],
        "none": [],
        "single triangle": [(0, 0), (50, 1), (3, 70)],
    }


@pytest.mark.parametrize("name", sorted(masks()))
def test_blocks_give_the_triangulation_of_the_whole(spark, name):
    cells = masks()[name]
    points = sorted(set(cells))
    want = {frozenset(points[i] for i in t) for t in D.triangulate(points)}
    rows = [*cells, *cells[:5], (None, 1), (2, None)]
    df = spark.createDataFrame(rows, "gx long, gy long").withColumns({"x": F.lit(1), "tx": F.lit("clash")})
    got = D.delaunay(df, side=8).collect()
    assert all(D._turn((r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)) > 0 for r in got)
    found = [frozenset({(r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)}) for r in got]
    assert len(found) == len(set(found)) and set(found) == want


def test_corners_have_their_elevation(spark):
    cells = spark.createDataFrame([(x, y, float(10 * x + y)) for x in range(6) for y in range(5) if (x, y) != (2, 2)], "gx long, gy long, elevation double")
    got = D.raised(D.delaunay(cells), cells, "elevation").collect()
    assert len(got) == 2 * 29 - 18 - 2 and all((r.az, r.bz, r.cz) == (10 * r.ax + r.ay, 10 * r.bx + r.by, 10 * r.cx + r.cy) for r in got)
    one = D.counted(D.delaunay(cells)).first()
    assert (one.n_triangles, one.n_hull, one.area2) == (38, 18, 40)


def test_blocks_come_one_by_one(spark):
    """What a task holds doesn't grow with the blocks of a batch, and no group is collected in the JVM."""
    import pyarrow as pa

    from skylattice.operators.blocks import Extent
    from skylattice.operators.folds import runs

    batch = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["tx", "by", "x"])
    stream = iter([batch([(0, "a", 1), (0, "a", 2), (0, None, 3)]), batch([(0, None, 4)]), batch([(0, None, 5), (1, None, 6)])])
    got = [(key, t.column("x").to_pylist()) for key, t in runs(stream, 2)]
    assert got == [((0, "a"), [1, 2]), ((0, None), [3, 4, 5]), ((1, None), [6])]
    cells = spark.createDataFrame([(1, 2, [(1, 3)], [(2, 2)])], "x long, y long, outs array<struct<x:bigint,y:bigint>>, ins array<struct<x:bigint,y:bigint>>")
    plan = D._round(cells, 8, 4, Extent(0, 0, 30, 30), False)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Sort" in plan


def test_squares_know_their_front_across_blocks(spark):
    cells = [(x, y) for x in range(-9, 12) for y in range(-5, 20) if (x, y) not in ((3, 3), (8, 8), (0, 16)) and not 5 < x < 7] + [(40, 40)]
    points = set(cells)
    rows = D._squares(spark.createDataFrame(cells + cells[:9], "x long, y long"), 8).collect()
    found = [((r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)) for r in rows if r.kind == 0]
    edges = {e for a, b, c in found for e in ((a, b), (b, c), (c, a))}
    assert len(edges) == 3 * len(found) and sum(D._turn(*t) for t in found) == len(found)
    front = [((r.ax, r.ay), (r.bx, r.by)) for r in rows if r.kind == 1]
    assert len(front) == len(set(front)) and set(front) == {e for e in edges if e[::-1] not in edges}
    assert {(r.ax, r.ay) for r in rows if r.kind == 2} == points - {p for t in found for p in t} == {(40, 40)}
