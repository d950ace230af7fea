"""Spark jobs: plans."""
