"""Incremental maintenance of additive results."""
