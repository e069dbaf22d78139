"""Operators for training-data pipelines; nothing else in tidemark imports this subpackage."""
