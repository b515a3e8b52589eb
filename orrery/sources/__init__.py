"""Readers, writers and the staged index."""
