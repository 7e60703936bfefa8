"""Repeat-measurement analytics on Spark DataFrames.

Points measured at different times are paired by distance, the pairs are looked up in
raster pixel tables, classified, and analysed. Every operator maps DataFrames to
DataFrames and is written in Catalyst expressions.
"""
