"""Structured Streaming jobs over the append-only event log."""
