"""Statement files, table schemas and the views over the given test tables."""
