"""Run telemetry on Spark: logs, counter files and run records of many runs as tables."""
