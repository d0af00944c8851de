"""Operators for training-text pipelines; nothing else in the package imports them."""
