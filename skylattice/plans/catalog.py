"""Registry of the mapping queries: name -> function of (spark, sf_dir), name -> SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register the decorated function, with its SQL if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


for _part in ("grid_queries", "mosaic_queries", "spatial_queries", "camera_queries", "geo_queries", "frame_queries", "export_queries", "chain_queries", "block_queries"):
    import_module(f"skylattice.plans.{_part}")
