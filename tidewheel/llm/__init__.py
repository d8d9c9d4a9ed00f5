"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; its queries are added to the entry
module only where it can be imported.
"""
