"""Operators for training data at scale. Nothing else in the library imports this subpackage."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
