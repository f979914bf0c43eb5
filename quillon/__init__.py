"""Spark-first forecast-evaluation and research-data operators."""
