"""Readers, writers and path layout."""
