"""Telemetry and traceability analytics as Spark DataFrame jobs."""
