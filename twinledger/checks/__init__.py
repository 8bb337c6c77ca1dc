"""Queries over the standard tables, each beside the SQL that checks it."""

from twinledger.checks.registry import ORACLE, QUERIES
from twinledger.checks import comparing, history, recording, ruling, schemas, searching, timing  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
