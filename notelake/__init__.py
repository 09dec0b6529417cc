"""Spark operators for large tables of short, tagged, optionally embedded notes."""
