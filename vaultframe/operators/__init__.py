"""Operators over DataFrames of entries, chunks, indexes and snapshots."""
