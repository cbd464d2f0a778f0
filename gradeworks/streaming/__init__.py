"""Structured Streaming jobs over growing tables of attempts."""
