"""Operators on DataFrames: diffs, ordered lines, spatial joins, faces, rasters, layouts."""
