"""Spark jobs for maintenance knowledge, retrieval, chat analytics and training data."""
