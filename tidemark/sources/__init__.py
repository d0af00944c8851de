"""Readers, writers and parsers of the stored tables."""
