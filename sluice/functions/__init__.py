"""Spark-first functions of the feed engine."""
