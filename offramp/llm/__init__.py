"""Operators for training-data pipelines over whole corpora. Nothing else in the library uses them."""
