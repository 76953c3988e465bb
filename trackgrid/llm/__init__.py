"""Operators for training-data pipelines on text; nothing else in the library imports them."""
