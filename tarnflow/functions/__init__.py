"""Spark jobs: functions."""
