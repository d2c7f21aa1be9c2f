"""Spark-first operators for catalogue, event-log and training-corpus processing."""
