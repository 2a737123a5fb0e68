"""Structured Streaming versions of log volume and the alert rules."""
