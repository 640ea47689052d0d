"""Spark engine for agent memory: versioned facts, ranked retrieval, outcome evidence, lifecycle and provenance."""
