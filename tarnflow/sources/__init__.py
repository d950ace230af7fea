"""Spark jobs: sources."""
