"""Column functions: vectors, text, dates, geometry."""
