"""Destinations of event batches."""
