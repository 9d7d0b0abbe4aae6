"""Column functions: descriptors, money, dates and name similarity."""
