"""Telemetry track analytics on Spark DataFrames."""
