"""Graph metadata and graph-level plans."""
