"""Operators of a training-data pipeline: filtering, near-duplicates, mixing, packing, search."""
