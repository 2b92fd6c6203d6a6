"""Structured Streaming jobs: landing, invalidation, product events."""
