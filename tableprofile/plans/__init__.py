"""The registered queries, each next to the SQL that gives the same result."""

from . import cleaning, discovery, documents, ingest, profiles, quality, questions, roles, sampling  # noqa: F401
from .registry import builders, oracles

__all__ = ["builders", "oracles"]
