"""Every registered query with its oracle."""

from storyloom.catalog import changing, deciding, ingesting, reading, streamed  # noqa: F401
from storyloom.catalog.registry import QUERIES

__all__ = ["QUERIES"]
