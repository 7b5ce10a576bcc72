"""Incident-evidence analytics on Spark DataFrames."""
