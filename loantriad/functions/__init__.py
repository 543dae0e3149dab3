"""Column expressions: parsing, labels, dates, metrics."""
