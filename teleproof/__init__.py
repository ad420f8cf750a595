"""Telemetry evidence on Spark: ordered records in, auditable tables out."""
