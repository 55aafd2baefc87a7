"""Granary: corpus preparation, auditing and retrieval on Spark."""
