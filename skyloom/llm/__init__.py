"""Operators for training-corpus preparation over a ``documents`` table."""
