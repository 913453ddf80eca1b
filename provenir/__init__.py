"""Provenance and audit-event analytics on PySpark: graphs as plain DataFrames."""
