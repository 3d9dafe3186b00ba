"""Operators for training-data pipelines; nothing else in skein imports them."""
