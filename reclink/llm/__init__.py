"""Operators for large-scale training-data preparation (self-contained; no other module imports them)."""
