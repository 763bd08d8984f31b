"""Distributed operators: relations over the library, matching, clustering, grouping, retention, enrichment, storage."""
