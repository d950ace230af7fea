"""Spark jobs: streaming."""
