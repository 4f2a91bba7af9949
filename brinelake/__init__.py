"""Telemetry of acoustic current and wave profilers as Spark datasets."""
