"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; the queries over the given tables
are in :mod:`tessera.llm.queries`.
"""
