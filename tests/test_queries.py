"""Every mapping query with SQL gives what DuckDB gives, at the smallest scale."""

import glob
import os

import pytest

from skylattice.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_lattice_queries_need_no_cartesian_product(spark):
    for name in ("idw_elevation", "knn2", "radius_neighbors", "rectify_cells", "consistency_votes", "ortho_frames", "ortho_mosaic", "undistort_images", "stereo_remap"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_georeference_folds_once(spark):
    plan = catalog.QUERIES["georef_init"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1  # the decomposition of the fits; the fold is a table by now
