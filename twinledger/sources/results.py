"""Stored difference results read back for viewing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def diffs_with_position(raw: DataFrame) -> DataFrame:
    """One row per difference with its position ``pos``.

    A wrapped document numbers its array; rows that are differences already
    get an increasing number in read order.
    """
    if "differences" in raw.columns:
        item = raw.schema["differences"].dataType
        if isinstance(item, T.ArrayType) and isinstance(item.elementType, T.StructType):
            return raw.select(F.posexplode("differences").alias("pos", "diff")).select("pos", "diff.*")
        return raw.select(F.posexplode("differences").alias("pos", "diff")).select("pos")
    if "pos" in raw.columns:
        return raw
    return raw.withColumn("pos", F.monotonically_increasing_id())


def scan_diffs(spark: SparkSession, path: str, wrapped: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """``(metadata, differences)`` of a wrapped document or a result folder.

    A folder's summary row names its format and row schema, so the differences
    are read without an inference pass and keep columns that are null everywhere.
    """
    if wrapped:
        raw = spark.read.json(path, multiLine=True)
        meta = raw.select("metadata") if "metadata" in raw.columns else None
        return meta, diffs_with_position(raw)
    summary = spark.read.json(f"{path}/summary")
    stored = summary.select("fileFormat", "rowSchema").first()
    schema = T.StructType.fromJson(json.loads(stored["rowSchema"]))
    rows = spark.read.schema(schema).format(stored["fileFormat"]).load(f"{path}/differences")
    return summary, diffs_with_position(rows)
