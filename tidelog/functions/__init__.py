"""Functions of the change-log engine."""
