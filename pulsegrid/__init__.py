"""Telemetry, reliability and early-warning analytics on Spark DataFrames."""
