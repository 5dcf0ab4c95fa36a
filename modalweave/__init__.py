"""Multimodal feature tables on Spark: join, split, fuse, score, evaluate, explain."""

__version__ = "0.1.0"
