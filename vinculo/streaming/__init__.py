"""Structured Streaming versions of the long-running jobs."""
