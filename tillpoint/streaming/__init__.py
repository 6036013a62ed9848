"""Incremental (Structured Streaming) variant of the row-local cleaning steps."""
