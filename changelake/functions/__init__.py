"""Column functions over change events."""
