"""Arrival-time policies as Structured Streaming jobs."""
