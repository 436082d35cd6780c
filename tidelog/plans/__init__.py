"""Plans of the change-log engine."""
