"""Incremental maps."""
