"""Records and ids of one side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions.ids import IdSpec, normalize_id, usable_id
from twinledger.functions.values import path_segments
from twinledger.model import ConfigError


def _field(col: Column, dtype: T.DataType, segments: list[str], where: str) -> tuple[Column, T.DataType]:
    """Walk struct fields; a record struct that lacks the field is an error.

    An empty JSON array infers as an array of strings.  It has no rows, so its
    elements may be anything: a scalar element only fails if one exists.
    """
    for segment in segments:
        if isinstance(dtype, T.StructType):
            if segment not in dtype.fieldNames():
                raise ConfigError(f"{where}: field '{segment}' not found among [{', '.join(dtype.fieldNames())}]")
            col, dtype = col.getField(segment), dtype[segment].dataType
        elif isinstance(dtype, T.MapType):
            col, dtype = col.getItem(segment), dtype.valueType
        else:
            message = F.lit(f"{where}: records are not objects, no field '{segment}'")
            return F.when(col.isNotNull(), F.raise_error(message).cast("string")), T.StringType()
    return col, dtype


def explode_records(df: DataFrame, root: str | tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of the repeated collection, in column ``record``.

    Several levels may be given; null and empty arrays yield no rows.  ``keep``
    names columns carried along.
    """
    levels = [root] if isinstance(root, str) else list(root)
    current = df
    for depth, level in enumerate(levels):
        segments = path_segments(re.sub(r"\[\*\]$", "", level))
        if depth == 0:
            if not segments or segments[0] not in df.columns:
                raise ConfigError(f"record root '{level}' not found among [{', '.join(df.columns)}]")
            start, dtype = F.col(f"`{segments[0]}`"), df.schema[segments[0]].dataType
            col, dtype = _field(start, dtype, segments[1:], f"record root '{level}'")
        else:
            col, dtype = _field(F.col("record"), current.schema["record"].dataType, segments, level)
        if not isinstance(dtype, T.ArrayType):
            raise ConfigError(f"record root '{level}' is not an array")
        current = current.select(*keep, F.explode(col).alias("record"))
    return current


def _as_object(dtype: T.DataType) -> Column:
    """A scalar record becomes an object with one field, ``value``."""
    return F.col("record") if isinstance(dtype, T.StructType) else F.struct(F.col("record").alias("value"))


def check_csv_column(df: DataFrame, column: str, label: str | None = None) -> None:
    """A missing id column is reported with what was found and why it may be."""
    if column in df.columns:
        return
    shown = [c.strip() or "(blank)" for c in df.columns]
    hints = []
    if any(c[:1] in ("{", "[") for c in shown):
        hints.append(
            "The staged file looks like JSON, so either the compare scope file type is wrong "
            "or the uploaded file does not match this saved run."
        )
    if shown and all(re.fullmatch(r"_c\d+", c) for c in shown):
        hints.append("The staged CSV does not expose named headers; check hasHeader and the uploaded file structure.")
    prefix = f"{label.strip()}: " if (label or "").strip() else ""
    raise ConfigError(
        f"{prefix}CSV compare source expected column '{column}' but available columns were "
        f"[{', '.join(shown) or '(none)'}]." + "".join(" " + hint for hint in hints)
    )


def extract_data(df: DataFrame, spec: IdSpec, label: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(compare_id, data)`` for every record with a usable id, duplicates kept.

    Columns named in ``keep`` stay beside the payload instead of inside it.
    """
    where = label or spec.expression
    if spec.explode:
        records = explode_records(df, spec.explode, keep)
        dtype = records.schema["record"].dataType
        raw_id, _ = _field(F.col("record"), dtype, path_segments(spec.path), where)
        return records.filter(usable_id(raw_id)).select(
            normalize_id(raw_id, spec.normalizer).alias("compare_id"), _as_object(dtype).alias("data"), *keep
        )
    else:
        if spec.path in df.columns:
            raw_id = F.col(f"`{spec.path}`")
        else:
            first, *rest = path_segments(spec.path)
            if not rest or first not in df.columns:
                check_csv_column(df, spec.path, label)
            raw_id, _ = _field(F.col(f"`{first}`"), df.schema[first].dataType, rest, where)
        payload = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keep])
        return df.filter(usable_id(raw_id)).select(
            normalize_id(raw_id, spec.normalizer).alias("compare_id"), payload.alias("data"), *keep
        )


def extract_ids(df: DataFrame, spec: IdSpec, label: str | None = None) -> DataFrame:
    """Distinct usable ids; the payload is pruned from the scan."""
    return extract_data(df, spec, label).select("compare_id").distinct()
