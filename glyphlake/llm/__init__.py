"""Operators for training-data pipelines: language, duplicates, mixing, encoding, quality."""
