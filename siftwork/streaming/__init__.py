"""Structured Streaming jobs over the logs and over new pool rows."""
