"""Loaders and generators of series: rows of (series_id, pos, value)."""
