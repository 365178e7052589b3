"""Column functions over feature rows."""
