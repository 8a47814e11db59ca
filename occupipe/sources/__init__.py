"""Readers, writers and the flattening of nested records."""
