"""Structured Streaming: incremental scoring of a growing execution log."""
