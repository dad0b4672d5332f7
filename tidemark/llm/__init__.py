"""Operators for large training-data corpora, all as Spark jobs.

Nothing outside this folder imports it; `registry` lists its queries.
"""
