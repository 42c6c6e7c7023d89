"""Structured Streaming operators (SS1-SS6)."""
