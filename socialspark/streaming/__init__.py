"""Incremental forms of the ingest plan."""
