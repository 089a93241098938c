"""Streaming: an extension beyond the batch operators, on event tables."""
