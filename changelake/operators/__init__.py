"""DataFrame operators over change logs."""
