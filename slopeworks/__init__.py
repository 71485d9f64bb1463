"""Tabular-regression analytics on Spark: profile, prepare, train, score and compare at scale."""

__version__ = "0.1.0"
