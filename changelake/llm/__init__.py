"""Corpus operators for large training-data pipelines.

Nothing outside this package imports it; deleting it leaves the rest of the
library whole.  Every operator takes and returns DataFrames; ``registry`` holds
the queries that apply them to the shared test tables.
"""
