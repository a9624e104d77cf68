"""Aerial-mapping analytics on Spark: rasters, clouds, frames and tiles as DataFrames."""
