"""Readers, writers and importers of the chunked graph format."""
