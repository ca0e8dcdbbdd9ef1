"""Readers and writers: domain tables, documents, answer keys, results and run records."""
