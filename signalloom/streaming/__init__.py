"""Incremental ingestion and event-time operators."""
