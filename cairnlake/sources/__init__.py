"""Readers for landed feeds and tables, and sinks."""
