"""Value semantics of rules: paths, conversions, comparison operators.

A ``Val`` couples a Column with its static type, so every decision that
depends on types is taken while the plan is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number patterns, pre-action names and aliases, truth words.
INTEGER_TEXT = r"^-?\d+$"
NUMBER_TEXT = r"^-?\d+(\.\d+)?$"
PRE_ACTIONS = {
    "STRING_TO_INT": "STRING_TO_INT",
    "STRING_TO_INTEGER": "STRING_TO_INT",
    "TO_INT": "STRING_TO_INT",
    "TO_INTEGER": "STRING_TO_INT",
    "STRING_TO_NUMBER": "STRING_TO_NUMBER",
    "TO_NUMBER": "STRING_TO_NUMBER",
}
TRUE_WORDS = ["y", "yes", "true", "1", "on"]
FALSE_WORDS = ["n", "no", "false", "0", "off"]
SECRET_PATTERN = r"(?i)(password|privateKey|apiToken|token)\s*[:=]\s*[^,\s)]+"
MESSAGE_LENGTH = 3900
DETAIL_LENGTH = 12000

# Sign (only of a value other than zero), digits without leading zeros, decimals
# without trailing zeros; blanks around a number do not count.
_NUMBER_PARTS = (
    r"^[\x00-\x20]*(?:(-)(?=[\d.]*[1-9])|-)?0*(\d+?)(?:\.(?=\d)(\d*?)0*)?[\x00-\x20]*$"
)
_NUMBER_MARK = "\x01"
_WHITESPACE = "".join(chr(code) for code in range(33))


@dataclass(frozen=True)
class Val:
    """A Column together with the type it will have."""

    col: Column
    type: T.DataType

    @property
    def integral(self) -> bool:
        return isinstance(self.type, T.IntegralType)

    @property
    def floating(self) -> bool:
        return isinstance(self.type, (T.FloatType, T.DoubleType))

    @property
    def fractional(self) -> bool:
        return isinstance(self.type, T.FractionalType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, T.StringType)


def null_val() -> Val:
    return Val(F.lit(None).cast("string"), T.StringType())


def strip_blank(col: Column) -> Column:
    """Strip every leading or trailing character up to and including space."""
    return F.btrim(col, F.lit(_WHITESPACE))


def text_of(value: Val) -> Column:
    """The text a rule sees for a value; null stays null."""
    if value.is_string:
        return value.col
    if isinstance(value.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value.col)
    if isinstance(value.type, T.TimestampType):
        return F.date_format(value.col, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    text = value.col.cast("string")
    if value.floating:
        return F.regexp_replace(text, r"E(\d)", "E+$1")
    return text


def literal_for(value: object, dtype: T.DataType) -> Column:
    """A constant of the column's own type, so that comparisons reach the scan."""
    return F.lit(value).cast(dtype)


# --- paths -------------------------------------------------------------------


# One step of a path: a quoted name or a bare index in brackets, or a name up to the next dot or bracket.
_PATH_TOKEN = re.compile(r"""\[\s*(?P<sign>['"])(?P<quoted>.*?)(?P=sign)\s*\]|\[(?P<index>[^\]]*)\]|(?P<bare>[^.\[\]]+)""")


def path_segments(path: str | None) -> list[str]:
    """``$.a['b'].c[0]`` to ``a, b, c, 0``; ``[*]`` becomes the key ``*``."""
    tokens = _PATH_TOKEN.finditer((path or "").strip().removeprefix("$"))
    return [name for token in tokens if (name := token["quoted"] or token["index"] or token["bare"])]


def value_at_path(source: Val, path: str | None) -> Val:
    """Nested value by path; anything absent is a typed null, never an error."""
    col, dtype = source.col, source.type
    for segment in path_segments(path):
        if isinstance(dtype, T.StructType):
            if segment not in dtype.fieldNames():
                return null_val()
            col, dtype = col.getField(segment), dtype[segment].dataType
        elif isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            col, dtype = col.getItem(segment), dtype.valueType
        elif isinstance(dtype, T.ArrayType) and re.fullmatch(r"\d+", segment):
            col, dtype = F.get(col, F.lit(int(segment))), dtype.elementType
        else:
            return null_val()
    return Val(col, dtype)


# --- comparison --------------------------------------------------------------


def values_differ(a: Val, b: Val) -> Column:
    """Strict, type-sensitive and null-safe inequality."""
    if a.type == b.type and not isinstance(a.type, T.MapType):
        return ~a.col.eqNullSafe(b.col)
    if a.integral and b.integral:
        return ~a.col.cast("bigint").eqNullSafe(b.col.cast("bigint"))
    if (a.fractional and b.fractional) or (_renders_as_text(a) and _renders_as_text(b)):
        return ~text_of(a).eqNullSafe(text_of(b))
    return a.col.isNotNull() | b.col.isNotNull()


def _renders_as_text(value: Val) -> bool:
    """Types that reach a rule as text or as a nested document."""
    return not isinstance(value.type, (T.NumericType, T.BooleanType))


def _plain_digits(value: Val) -> Column:
    """A typed value as text, with plain digits where it is a number."""
    if not isinstance(value.type, T.NumericType):
        return text_of(value)
    text = value.col.cast("string")
    if not value.floating:
        return text
    # Doubles print large and small magnitudes as d.dddE±n: expand to digits.
    shape = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, head, tail = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    power = F.regexp_extract(text, shape, 4).try_cast("int")
    digits = F.concat(head, F.rpad(tail, F.greatest(F.length(tail), power), F.lit("0")))
    large = F.concat(
        sign, F.substring(digits, F.lit(1), power + 1), F.lit("."),
        F.concat(F.substring(digits, power + 2, F.length(digits)), F.lit("0")),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), head, tail)
    return F.when(power >= 0, large).when(power < 0, small).otherwise(text)


def _number_key(value: Val) -> Column:
    """Numbers as ``0x01`` sign digits ``.`` digits without padding; other text unchanged.

    Equal numbers of any length share one key, however they are written.
    """
    text = value.col if value.is_string else _plain_digits(value)
    return F.regexp_replace(text, _NUMBER_PARTS, _NUMBER_MARK + "$1$2.$3")


def _is_number(key: Column) -> Column:
    return key.startswith(_NUMBER_MARK)


def _sort_key(key: Column) -> Column:
    """Text that sorts as the number does: length first, digits complemented below zero."""
    negative = key.startswith(_NUMBER_MARK + "-")
    digits = F.substring(key, 2, 2_000_000_000)
    size = F.locate(".", key)
    below = F.concat(
        F.lit("0"), F.lpad((F.lit(4_000_000_000) - size).cast("string"), 10, "0"),
        F.translate(digits, "0123456789", "9876543210"), F.lit("~"),
    )
    above = F.concat(F.lit("1"), F.lpad(size.cast("string"), 10, "0"), digits)
    return F.when(negative, below).otherwise(above)


def _comparable_directly(a: Val, b: Val) -> bool:
    return (a.integral and b.integral) or (a.floating and b.floating)


def _equal(a: Val, b: Val) -> Column:
    """Null equals null; numbers by value whatever their notation; else text."""
    if _comparable_directly(a, b):
        return a.col.eqNullSafe(b.col)
    same = (text_of(a) == text_of(b)) | (_number_key(a) == _number_key(b))
    return F.coalesce(same, a.col.isNull() & b.col.isNull())


def _less(a: Val, b: Val) -> Column:
    """Null sorts before any value; two numbers by value, anything else as text."""
    if _comparable_directly(a, b):
        smaller = a.col < b.col
    else:
        key_a, key_b = _number_key(a), _number_key(b)
        both = _is_number(key_a) & _is_number(key_b)
        smaller = F.when(both, _sort_key(key_a) < _sort_key(key_b)).otherwise(text_of(a) < text_of(b))
    return F.coalesce(smaller, a.col.isNull() & b.col.isNotNull())


def matches_operator(a: Val, b: Val, operator: str | None) -> Column:
    op = (operator or "").strip() or "="
    if op == "!=":
        return ~_equal(a, b)
    if op == ">":
        return _less(b, a)
    if op == "<":
        return _less(a, b)
    if op == ">=":
        return ~_less(a, b)
    if op == "<=":
        return ~_less(b, a)
    return _equal(a, b)


def violates_operator(a: Val, b: Val, operator: str | None) -> Column:
    return ~matches_operator(a, b, operator)


# --- conversions -------------------------------------------------------------


def pre_action_names(raw) -> list[str]:
    """Known conversions in the order given; other names are dropped."""
    if raw is None:
        return []
    items = raw if isinstance(raw, (list, tuple)) else [raw]
    names = [str(item).strip().upper() for item in items if item is not None]
    return [PRE_ACTIONS[name] for name in names if name in PRE_ACTIONS]


def side_pre_actions(raw) -> dict[str, list[str]]:
    """Per-side conversions of a field comparison, without repeats."""
    sides = {"file1": "file1", "file_1": "file1", "left": "file1",
             "file2": "file2", "file_2": "file2", "right": "file2"}
    result: dict[str, list[str]] = {"file1": [], "file2": []}
    items = raw if isinstance(raw, (list, tuple)) else ([] if raw is None else [raw])
    for item in items:
        if isinstance(item, dict):
            action = item.get("action") or item.get("preAction")
            side = item.get("fieldSide") or item.get("field") or item.get("side")
            targets = [sides.get(str(side or "").strip().lower())]
        else:
            action, targets = item, ["file1", "file2"]
        for name in pre_action_names(action):
            for target in targets:
                if target and name not in result[target]:
                    result[target].append(name)
    return result


def apply_pre_actions(value: Val, actions) -> Val:
    for name in pre_action_names(actions):
        value = to_integer(value) if name == "STRING_TO_INT" else to_number(value)
    return value


def to_integer(value: Val) -> Val:
    if value.integral:
        return Val(value.col.cast("bigint"), T.LongType())
    text = strip_blank(text_of(value))
    return Val(F.when(text.rlike(INTEGER_TEXT), text.try_cast("bigint")), T.LongType())


def to_number(value: Val) -> Val:
    """Numbers stay as they are; numeric text becomes its plain digits.

    Digits are kept as text because comparison is exact on digit strings and
    a decimal column would bound the precision.
    """
    if isinstance(value.type, T.NumericType):
        return value
    text = strip_blank(text_of(value))
    digits = F.regexp_replace(text, r"^(-?)0+(?=\d)", "$1")
    return Val(F.when(text.rlike(NUMBER_TEXT), digits), T.StringType())


# --- column cleaning ---------------------------------------------------------


def norm_text(col: Column, blank_to_null: bool = False) -> Column:
    text = strip_blank(col.cast("string"))
    return F.nullif(text, F.lit("")) if blank_to_null else text


def norm_bool(col: Column, default: bool = False) -> Column:
    word = F.lower(strip_blank(col.cast("string")))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False)).otherwise(
        F.lit(default)
    )


def _norm_integer(col: Column, default: int | None, target: str) -> Column:
    text = strip_blank(col.cast("string"))
    parsed = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(target))
    return F.coalesce(parsed, F.lit(default).cast(target))


def norm_int(col: Column, default: int | None = None) -> Column:
    return _norm_integer(col, default, "int")


def norm_long(col: Column, default: int | None = None) -> Column:
    return _norm_integer(col, default, "bigint")


def redact_secrets(col: Column, max_length: int | None = None) -> Column:
    """Mask credential values, then cut to the stored length."""
    masked = F.regexp_replace(col, SECRET_PATTERN, "$1=***")
    return masked if max_length is None else F.substring(masked, 1, max_length)


def canonical_system(col: Column, aliases: dict[str, str]) -> Column:
    """Fold system names onto their code; ``aliases`` maps folded names to codes."""
    name = strip_blank(col)
    folded = F.upper(F.regexp_replace(name, r"[\s_-]", ""))
    pairs = [F.lit(item) for pair in aliases.items() for item in pair]
    known = F.create_map(*pairs)[folded] if pairs else F.lit(None)
    return F.coalesce(known, F.nullif(name, F.lit("")))
