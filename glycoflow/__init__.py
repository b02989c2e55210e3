"""Glucose and insulin time-series analytics as Spark DataFrame, SQL and Structured Streaming jobs."""
