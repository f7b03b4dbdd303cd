"""Continuous forms of the ingest job."""
