"""Spark jobs: operators."""
