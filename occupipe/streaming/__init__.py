"""Structured Streaming forms of ingest, enrichment, counting and scoring."""
