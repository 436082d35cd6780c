"""Operators of the change-log engine."""
