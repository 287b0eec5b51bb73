"""Structured Streaming forms of ingest, live metrics, rollups and sessions."""
