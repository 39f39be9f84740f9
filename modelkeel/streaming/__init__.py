"""Structured Streaming jobs: log append, windows, alert holds, breaker timelines."""
