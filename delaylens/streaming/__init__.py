"""Structured Streaming jobs over arriving orders."""
