"""Configuration records and the fixed output layouts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T


def _all_strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType(), True) for name in names])


# Output column layouts.
MISSING_DIFF_COLUMNS = ["type", "id", "presentIn", "missingIn", "data", "note"]
RULESET_DIFF_COLUMNS = [
    "diffType", "compareScopeId", "objectType", "primaryId", "field", "file1Value", "file2Value",
    "presentIn", "missingIn", "data", "ruleId", "severity", "message",
]
LEGACY_CSV_LAYOUT = ["type", "id", "presentIn", "missingIn", "note", "data"]
RULESET_CSV_LAYOUT = [
    "diffType", "primaryId", "field", "file1Value", "file2Value", "presentIn", "missingIn",
    "ruleId", "severity", "message", "data",
]

# Status codes, window kinds, difference kinds, file sides.
STATUS_PENDING = "AUT_STAT_PENDING"
STATUS_RUNNING = "AUT_STAT_RUNNING"
STATUS_SUCCESS = "AUT_STAT_SUCCESS"
STATUS_FAILED = "AUT_STAT_FAILED"
STATUS_NO_DATA = "AUT_STAT_NO_DATA"
STATUS_SKIPPED = "AUT_STAT_SKIP_DUP"
WINDOW_PREVIOUS_DAY = "AUT_WIN_PREV_DAY"
WINDOW_PREVIOUS_WEEK = "AUT_WIN_PREV_WEEK"
WINDOW_PREVIOUS_MONTH = "AUT_WIN_PREV_MONTH"
WINDOW_LAST_DAYS = "AUT_WIN_LAST_DAYS"
WINDOW_LAST_WEEKS = "AUT_WIN_LAST_WEEKS"
WINDOW_LAST_MONTHS = "AUT_WIN_LAST_MONTHS"
WINDOW_CUSTOM = "AUT_WIN_CUSTOM"
MISSING_IN_1 = "MISSING_IN_FILE_1"
MISSING_IN_2 = "MISSING_IN_FILE_2"
FIELD_MISMATCH = "FIELD_MISMATCH"
BUSINESS_RULE_DIFF = "BUSINESS_RULE_DIFF"
FILE_1 = "FILE_1"
FILE_2 = "FILE_2"

MISSING_DIFF_SCHEMA = _all_strings(MISSING_DIFF_COLUMNS)
RULESET_DIFF_SCHEMA = _all_strings(RULESET_DIFF_COLUMNS)


class ConfigError(ValueError):
    """A configuration or input problem the user has to fix."""


@dataclass(frozen=True)
class SideConfig:
    """One side of a compare scope: where ids live and how they normalise."""

    id_expression: str
    file_type: str | None = None
    record_root: str | None = None
    id_normalizer: str | None = None
    label: str | None = None
    system: str | None = None
    schema: dict | None = None


@dataclass(frozen=True)
class Rule:
    """One rule of a rule set.

    Kinds: ``FIELD_COMPARISON`` (``expression`` holds the JSON settings),
    ``CONDITION`` (``text`` in the small condition language, matches only),
    ``BUSINESS_RULE`` (``text`` plus a difference to emit) and ``FUNCTION``
    (a Python function from pair columns to a boolean Column).
    """

    rule_id: str
    sequence: int = 0
    kind: str = "CONDITION"
    text: str | None = None
    expression: str | dict | None = None
    severity: str | None = None
    message: str | None = None
    diff_type: str | None = None
    enabled: bool = True
    function: Callable | None = None
    field: str | None = None

    def settings(self) -> dict:
        if not self.expression:
            return {}
        if isinstance(self.expression, dict):
            return self.expression
        try:
            parsed = json.loads(self.expression)
        except ValueError:
            return {}
        return parsed if isinstance(parsed, dict) else {}


@dataclass(frozen=True)
class CompareScope:
    """Two sides, an optional object type and the rules that apply to pairs."""

    scope_id: str
    side1: SideConfig
    side2: SideConfig
    object_type: str | None = None
    description: str | None = None
    rule_set_id: str | None = None
    rules: tuple[Rule, ...] = ()

    @property
    def label(self) -> str:
        return (self.description or "").strip() or self.scope_id.strip()

    def active_rules(self) -> list[Rule]:
        return sorted((r for r in self.rules if r.enabled), key=lambda r: (r.sequence, r.rule_id))


@dataclass(frozen=True)
class MappingMember:
    """One system of a saved mapping (the presence-only configuration)."""

    system: str
    id_expression: str | None = None
    file_type: str | None = None
    schema_name: str | None = None
    id_normalizer: str | None = None
    label: str | None = None


@dataclass
class RunResult:
    """What a reconciliation hands back: frames plus one-row numbers."""

    diffs: object
    summary: dict
    warnings: list[str] = field(default_factory=list)
    validation_errors: object = None
    pairs: object = None
    small: bool = False  # the missing ids were measured as fit to broadcast
