"""Record files and staged-file checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions.values import literal_for
from twinledger.sources.csvsplit import CSV_OPTIONS

# Preview size and the words that mark a JSON-Schema document.
PREVIEW_CHARS = 8192
SCHEMA_MARK = '"$schema"'
SCHEMA_WORDS = ['"properties"', '"items"', '"definitions"', '"$defs"']


def scan_csv(
    spark: SparkSession, path: str | list[str], header: bool = True, multi_line: bool = True
) -> DataFrame:
    """CSV with every field a string; a quote within quotes is written twice.

    ``multi_line=False`` lets Spark split large files; keep the default when
    quoted fields may hold line breaks, or use ``scan_csv_split``, which splits
    such files too.
    """
    return spark.read.csv(path, header=header, multiLine=multi_line, **CSV_OPTIONS)


def scan_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    json_lines: bool = False,
) -> DataFrame:
    """JSON documents, one row per root element; ``json_lines`` files are splittable.

    ``scan_json_split`` splits files that hold one array, too.
    """
    return spark.read.json(path, schema=schema, multiLine=not json_lines)


def file_type(configured: str | None, file_name: str | None) -> tuple[str, bool]:
    """Type by configuration, else by extension, else CSV; the flag says it was guessed."""
    code = (configured or "").strip().upper()
    if code:
        return ("JSON" if "JSON" in code else "CSV" if "CSV" in code else code), False
    name = (file_name or "").lower()
    for extension in ("csv", "json"):
        if name.endswith("." + extension):
            return extension.upper(), False
    return "CSV", True


def run_type(type1: str, type2: str) -> str:
    both = {type1.strip().upper(), type2.strip().upper()}
    return both.pop() if both in ({"CSV"}, {"JSON"}) else "MIXED"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and modification time of files; contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )


def file_heads(files: DataFrame, path_col: str = "path") -> DataFrame:
    """The first ``PREVIEW_CHARS`` characters of each listed file.

    Only the head of a file is opened, inside the task that holds its row, so
    a folder of very large files costs a few kilobytes per file.
    """
    fields = [f for f in files.schema.fields] + [T.StructField("head", T.StringType())]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for batch in batches:
            heads = []
            for path in batch[path_col]:
                filesystem, location = pafs.FileSystem.from_uri(path)
                with filesystem.open_input_stream(location) as stream:
                    heads.append(stream.read(PREVIEW_CHARS * 4).decode("utf-8", "ignore")[:PREVIEW_CHARS])
            yield batch.assign(head=heads)

    return files.mapInPandas(read, T.StructType(fields))


def payload_shape(head: Column) -> Column:
    """``JSON_SCHEMA``, ``JSON``, ``OTHER``, or null for a blank head."""
    text = F.btrim(head, F.lit("".join(chr(c) for c in range(33))))
    lowered = F.lower(text)
    is_json = text.startswith("{") | text.startswith("[")
    words = F.lit(False)
    for word in SCHEMA_WORDS:
        words = words | F.contains(lowered, F.lit(word))
    is_schema = F.contains(lowered, F.lit(SCHEMA_MARK)) & words
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(is_json & is_schema, "JSON_SCHEMA")
        .when(is_json, "JSON")
        .otherwise("OTHER")
    )


def payload_shape_guard(
    files: DataFrame, head_col: str = "head", type_col: str = "declared_type",
    name_col: str = "file_name", label_col: str = "label",
) -> DataFrame:
    """Adds ``shape`` and ``error``; a matching or blank file has a null error."""
    shape = payload_shape(F.col(head_col))
    declared = F.upper(F.trim(F.col(type_col)))
    name = F.coalesce(F.nullif(F.trim(F.col(name_col)), F.lit("")), F.lit("uploaded file"))
    label = F.coalesce(F.nullif(F.trim(F.col(label_col)), F.lit("")), name)
    upload = " Upload the source data file for this saved run instead"
    csv_but_json = F.concat(
        label, F.lit(" expects CSV data, but "), name, F.lit(" looks like "),
        F.when(F.col("shape") == "JSON_SCHEMA", "a JSON Schema document").otherwise("JSON"),
        F.lit(f".{upload}."),
    )
    json_but_other = F.concat(
        label, F.lit(" expects JSON data, but "), name, F.lit(f" does not look like JSON.{upload}.")
    )
    json_but_schema = F.concat(
        label, F.lit(" expects JSON records, but "), name,
        F.lit(f" looks like a JSON Schema document.{upload} of the schema definition."),
    )
    error = (
        F.when((declared == "CSV") & F.col("shape").isin("JSON", "JSON_SCHEMA"), csv_but_json)
        .when((declared == "JSON") & (F.col("shape") == "OTHER"), json_but_other)
        .when((declared == "JSON") & (F.col("shape") == "JSON_SCHEMA"), json_but_schema)
    )
    return files.withColumn("shape", shape).withColumn("error", error)


def newest_file_per_side(
    listing: DataFrame, side_col: str = "side", archive_folder: str | None = None
) -> DataFrame:
    """Newest plain file of each side: by modification time, then by name.

    ``max_by`` pre-aggregates per task, so a side with a huge folder is never
    sorted in one place.
    """
    files = listing.filter(F.col("is_file") & ~F.col("is_directory"))
    if archive_folder:
        files = files.filter(
            (F.col("name") != archive_folder) & ~F.col("path").endswith("/" + archive_folder)
        )
    row = F.struct(*[F.col(f"`{c}`") for c in listing.columns])
    newest = files.groupBy(side_col).agg(
        F.max_by(row, F.struct(F.coalesce(F.col("mtime"), F.timestamp_micros(F.lit(0))),
                               F.coalesce(F.col("name"), F.lit("")))).alias("row")
    )
    return newest.select("row.*")


def extract_window(df: DataFrame, ts_col: str, start, end) -> DataFrame:
    """Records in ``[start, end)``; the plain comparison reaches the scan."""
    dtype = df.schema[ts_col].dataType
    return df.filter((F.col(ts_col) >= literal_for(start, dtype)) & (F.col(ts_col) < literal_for(end, dtype)))
