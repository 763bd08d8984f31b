"""Operators for training-data pipelines: linkage, near-duplicates, text repair, tokens, screening."""
