"""Structured Streaming ingestion into vertex tables."""
