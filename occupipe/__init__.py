"""Spark jobs for coding text records to a prefix-nested classification."""
