"""Matrices from tables, strips, blocks and keyed random numbers; Parquet layouts."""
