"""Operators for text corpora that feed language models."""
