"""Spark-first streaming of the feed engine."""
