"""Sources of the change-log engine."""
