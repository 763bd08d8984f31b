"""Incremental recomputation as files arrive."""
