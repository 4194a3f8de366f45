"""Readers of change events."""
