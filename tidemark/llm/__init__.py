"""Operators for training-data pipelines over very large text corpora."""
