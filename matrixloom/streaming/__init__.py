"""Structured Streaming forms of the commutative aggregates."""
