"""Intentionally empty: the workflow this library rebuilds has no streaming, watermarks or state.

The row-level operators (marker cleaning, recodes, conditional nulls, derived columns) are plain
projections and filters, so they already apply unchanged to a ``readStream`` DataFrame; the
per-key rules need whole series and stay batch jobs.
"""
