"""The small human-readable condition language, compiled to a Column."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions.values import NUMBER_TEXT, Val, null_val, strip_blank, text_of

# Operator phrases and the comparison each one means.
OPERATORS = {
    "greater than or equals": ">=",
    "less than or equals": "<=",
    "greater than": ">",
    "not equals": "!=",
    "less than": "<",
    "is not": "!=",
    "equals": "==",
    "is": "==",
    ">=": ">=",
    "<=": "<=",
    ">": ">",
    "<": "<",
}
# Phrases are tried in this order: containment first, then the table's.
_CONTAINMENT = {"does not contain": "not contains", "not contains": "not contains", "contains": "contains"}
_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")


def _split(text: str, phrase: str) -> tuple[str, str] | None:
    """What stands before and after a phrase of whole words outside quotes; None unless both are given."""
    bare = _QUOTED.sub(lambda quoted: "_" * len(quoted[0]), text)
    found = re.search(rf"(?<=\s){r'\s+'.join(map(re.escape, phrase.split()))}(?=\s)", bare, re.IGNORECASE)
    if found is None:
        return None
    field, value = text[: found.start()].strip().strip("'\"`"), text[found.end():].strip()
    return (field, value) if field and value else None


def _literal(text: str):
    """A quoted string, a number, true, false, null, or the bare text."""
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if re.fullmatch(NUMBER_TEXT.strip("^$"), text):
        return Decimal(text)
    return {"true": True, "false": False, "null": None}.get(text.lower(), text)


def parse_condition(text: str | None) -> tuple[str, str, object] | None:
    """``(field, operator, value)`` or None when the text is not a condition."""
    raw = (text or "").strip()
    if not raw:
        return None
    for phrase, operator in (_CONTAINMENT | OPERATORS).items():
        parts = _split(raw, phrase)
        if parts:
            return parts[0], operator, _literal(parts[1])
    return None


def _compare(value: Val, operator: str, literal) -> Column:
    if literal is None:
        absent = value.col.isNull()
        return absent if operator == "==" else (~absent if operator == "!=" else F.lit(False))
    if isinstance(literal, Decimal):
        digits = str(literal)
        if isinstance(value.type, T.NumericType):
            left, right = value.col, F.lit(int(literal) if "." not in digits else float(literal))
            if isinstance(value.type, T.DecimalType):
                right = F.lit(literal)
        else:
            text = strip_blank(text_of(value))
            left = F.when(text.rlike(NUMBER_TEXT), text.try_cast("decimal(38,18)"))
            right = F.lit(literal).cast("decimal(38,18)")
    elif isinstance(literal, bool):
        if isinstance(value.type, T.BooleanType):
            left, right = value.col, F.lit(literal)
        else:
            left, right = F.lower(text_of(value)), F.lit(str(literal).lower())
    else:
        left, right = text_of(value), F.lit(literal)
    if operator == "==":
        return left.eqNullSafe(right)
    if operator == "!=":
        return ~left.eqNullSafe(right)
    ordered = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[operator]
    return F.coalesce(ordered, F.lit(False))


def rule_condition(text: str | None, schema: T.StructType) -> Column | None:
    """Compile a condition against the top-level columns of ``schema``.

    A field the schema does not have behaves as null, as an absent key would.
    """
    parsed = parse_condition(text)
    if parsed is None:
        return None
    field, operator, literal = parsed
    if field in schema.fieldNames():
        value = Val(F.col(f"`{field.replace('`', '``')}`"), schema[field].dataType)
    else:
        value = null_val()
    if operator in ("contains", "not contains"):
        needle = "null" if literal is None else str(literal).lower() if isinstance(literal, bool) else str(literal)
        inside = F.coalesce(F.contains(text_of(value), F.lit(needle)), F.lit(False))
        return inside if operator == "contains" else ~inside
    return _compare(value, operator, literal)
