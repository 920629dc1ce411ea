"""Spark-first operators of the feed engine."""
