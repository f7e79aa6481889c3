"""Anomaly detection over HTTP traffic as Spark DataFrame jobs."""
