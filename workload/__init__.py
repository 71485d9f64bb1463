"""Queries over the test tables, each with the SQL that must give the same rows."""

from workload.registry import ORACLES, QUERIES
from workload import clean, encode, features, learn, moments, profile, runs, scale, score, segments, stream  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
