"""Operators of a training-data pipeline: scoring, archives, scans, dedup, packing.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; module docstrings state the result for nulls, empty and very
long texts, ties, repeated rows, empty tables and extra columns.
"""
