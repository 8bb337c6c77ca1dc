"""Comparison-id grammar (plan time) and id normalisation (Column)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinledger.model import ConfigError

# Normaliser code, id patterns.
GID_TAIL = "SHOPIFY_GID_TAIL"
GID_PATTERN = r"gid://shopify/[^/]+/(\d+)(?:\?.*)?"
TRAILING_DIGITS_PATTERN = r"(\d+)"

# One match decides: a global id that runs to the end, else digits at the end.
_TAIL = rf"^(?s:.*?)(?:{GID_PATTERN}|{TRAILING_DIGITS_PATTERN})$\R?"

_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PATH_STEP = re.compile(r"\.?(?:\[\*\]|\[\d+\]|\['[^']+'\]|\[\"[^\"]+\"\])|\.[^.\[\]]+")


@dataclass(frozen=True)
class IdSpec:
    """Where the id sits: levels to explode, then a field path inside the record."""

    explode: tuple[str, ...]
    path: str
    normalizer: str | None
    expression: str


def split_expression(text: str | None) -> tuple[str | None, str | None]:
    """``expr|NORMALIZER`` splits at the first bar."""
    raw = (text or "").strip()
    if not raw:
        return None, None
    expr, bar, code = raw.partition("|")
    return expr.strip(), (code.strip() if bar else None)


def normalizer_code(code: str | None) -> str | None:
    raw = (code or "").strip()
    if not raw:
        return None
    if re.sub(r"[- ]", "_", raw).upper() == GID_TAIL:
        return GID_TAIL
    raise ConfigError(f"Unsupported ID normalizer '{code}'. Supported value: {GID_TAIL}")


def star_indices(path: str) -> str:
    """Positions address every element: ``[3]`` and ``.[3]`` both mean ``[*]``."""
    return re.sub(r"\.?\[\d+\]", "[*]", path).replace(".[*]", "[*]")


def json_id_path(expr: str | None) -> str:
    """Full ``$`` path of a JSON id expression."""
    raw = (expr or "").strip()
    if not raw:
        return "$.id"
    path = star_indices(raw)
    if not path.startswith("$"):
        if path[0] in "[.":
            path = "$" + path
        elif _PLAIN_NAME.fullmatch(path):
            path = f"$[*].{path}"
        else:
            path = "$." + path
    check_json_path(path)
    return path


def check_json_path(path: str) -> None:
    position = 1
    while position < len(path):
        step = _PATH_STEP.match(path, position)
        if step is None:
            raise ConfigError(f"Invalid JSONPath '{path}': unexpected text at position {position}")
        position = step.end()


def csv_id_column(expr: str | None) -> str:
    """A ``$`` path names its last segment; blank means ``id``."""
    raw = (expr or "").strip()
    if not raw:
        return "id"
    if not raw.startswith("$"):
        return raw
    segments = [s for s in raw.split(".") if s]
    return re.sub(r"\[.*\]", "", segments[-1]) if segments else "id"


def parse_id_spec(expression: str | None, file_type: str, normalizer: str | None = None) -> IdSpec:
    expr, inline = split_expression(expression)
    code = normalizer_code(normalizer) or normalizer_code(inline)
    if file_type.upper() == "CSV":
        column = csv_id_column(expr)
        return IdSpec((), column, code, column)
    path = json_id_path(expr)
    # A root array is already one row per element after the read.
    relative = re.sub(r"^\$(\[\*\])?\.?", "", path)
    *levels, leaf = relative.split("[*]")
    levels = tuple(level.lstrip(".") for level in levels)
    leaf = leaf.lstrip(".")
    if not levels and not leaf:
        raise ConfigError(f"JSONPath {path} resolves to an empty field path.")
    return IdSpec(levels, leaf, code, path)


def join_record_root(root: str | None, id_expression: str | None) -> str | None:
    """Prefix the record root, unless the id path already starts with it."""
    raw_root = (root or "").strip()
    if not raw_root:
        return id_expression
    base = star_indices(raw_root)
    if not base.endswith("]"):
        base += "[*]"
    if not base.startswith("$"):
        base = ("$" if base[0] in "[." else "$.") + base
    relative_root = re.sub(r"^\$\.?", "", base)
    leaf = star_indices((id_expression or "").strip())
    leaf = re.sub(r"^\$\[\*\]\.?|^\$\.|^\$", "", leaf, count=1).lstrip(".")
    if not leaf:
        return base
    if relative_root and re.match(re.escape(relative_root) + r"($|\.|\[\*\])", leaf):
        return ("$" if leaf.startswith("[") else "$.") + leaf
    return base.rstrip(".") + "." + leaf


def normalize_id(col: Column, code: str | None = None) -> Column:
    """Trim spaces; optionally keep only the numeric tail of a global id."""
    text = F.trim(col.cast("string"))
    if normalizer_code(code) is None:
        return text
    return F.regexp_replace(text, _TAIL, "$1$2")


def usable_id(raw: Column) -> Column:
    """Not null and not blank.  Normalising never blanks an id, so the raw value
    decides and the check runs before any pattern."""
    return raw.isNotNull() & (F.length(F.trim(raw.cast("string"))) > 0)
