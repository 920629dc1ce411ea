"""Spark-first plans of the feed engine."""
