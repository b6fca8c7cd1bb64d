"""Column expressions: text, numbers, dates and fixed lookups."""
