"""Spark-native analytics over satellite detection telemetry."""
