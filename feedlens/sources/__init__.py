"""Scans, ingest and sinks."""
