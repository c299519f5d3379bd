"""Composite plans: scoring models, scheduling, resolution and serving queries."""
