"""Streaming of the change-log engine."""
