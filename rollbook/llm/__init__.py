"""Operators for training-data pipelines. Nothing else in the library imports this package."""

from rollbook.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
