"""Structured Streaming variants of the enrichment operators."""
