"""Operators for training-data pipelines: filtering, deduplication, mixing and encoding of text."""
