"""DataFrame operators keyed by tenant."""
