"""Running pipelines: configuration, state, retries, metrics."""
