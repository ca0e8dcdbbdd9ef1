"""Column expressions: cell readings, attributes, text and metrics."""
