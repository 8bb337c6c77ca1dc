"""Spark-native reconciliation of two record sets.

DataFrames in, DataFrames out.  The library never creates a session, never
starts a server and keeps the driver to configuration and one-row summaries.
"""

from twinledger.model import CompareScope, MappingMember, Rule, SideConfig
from twinledger.plans.reconcile import (
    base_diff,
    reconcile_by_mapping,
    reconcile_ids,
    reconcile_ruleset,
    reconcile_unified,
)

__all__ = [
    "CompareScope",
    "MappingMember",
    "Rule",
    "SideConfig",
    "base_diff",
    "reconcile_by_mapping",
    "reconcile_ids",
    "reconcile_ruleset",
    "reconcile_unified",
]
