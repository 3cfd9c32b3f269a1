"""Operators of a training-data pipeline (near duplicates, packing, mixing, ...).

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only if it can be imported.
"""
