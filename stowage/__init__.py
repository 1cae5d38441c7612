"""Spark jobs for moving, checking, recording and restoring bundles of files.

Every operator takes DataFrames and returns DataFrames; nothing here collects
data on the driver.  See README.md for the map from task to function.
"""
