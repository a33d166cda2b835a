"""Crash-report and reduction-telemetry analytics on Spark."""
