"""Structured Streaming: an extension beyond batch tables."""
