"""Structured Streaming jobs: report arrival and verdict reuse."""
