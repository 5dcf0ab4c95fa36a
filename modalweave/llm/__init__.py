"""Operators for training data: one module each, their queries in queries.py, the same as SQL in oracle.py."""
