"""Incremental matching."""
