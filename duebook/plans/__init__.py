"""Reports, the end-to-end batch and the registered queries."""
