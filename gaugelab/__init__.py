"""Tabular sensor-risk analytics expressed as Spark DataFrame jobs."""
