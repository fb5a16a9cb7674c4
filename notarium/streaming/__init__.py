"""Structured Streaming jobs and the polling schedule."""
