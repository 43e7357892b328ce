"""Operators for training-data pipelines over the `documents` tables; nothing else in the package imports this folder."""
