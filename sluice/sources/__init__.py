"""Spark-first sources of the feed engine."""
