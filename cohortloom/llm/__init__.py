"""Operators of a training-data pipeline: text in, cleaned, scored, sharded and packed text out."""
