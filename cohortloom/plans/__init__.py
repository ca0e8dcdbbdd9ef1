"""Composed jobs over one snapshot, and the registered queries with their SQL twins."""
