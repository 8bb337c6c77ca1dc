"""Writers of difference results."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from twinledger.model import LEGACY_CSV_LAYOUT, RULESET_CSV_LAYOUT


def _write_new(write, path: str, attempts: int = 10_000) -> str:
    """Write to ``path`` or the first free ``path-1``, ``path-2`` …; never overwrite."""
    for suffix in range(attempts):
        target = path if suffix == 0 else f"{path}-{suffix}"
        try:
            write(target)
            return target
        except AnalysisException as problem:
            if "PATH_ALREADY_EXISTS" not in str(problem):
                raise
    raise FileExistsError(path)


def write_diffs(
    df: DataFrame, path: str, metadata: dict | None = None, summary: dict | None = None,
    validation_errors: list[str] | None = None, warnings: list[str] | None = None, file_format: str = "json",
) -> str:
    """A result folder: ``differences`` in parallel files, one ``summary`` row.

    The row count is observed while writing, so the differences are computed
    once.  Returns the folder used.
    """
    counted = Observation()
    observed = df.observe(counted, F.count(F.lit(1)).alias("rows"))

    def write(target: str) -> None:
        observed.write.mode("error").format(file_format).save(f"{target}/differences")

    target = _write_new(write, path)
    row = {
        "metadata": json.dumps(metadata or {}, default=str),
        "summary": json.dumps(dict(summary or {}, writtenRows=counted.get["rows"]), default=str),
        "validationErrors": list(validation_errors or []),
        "processingWarnings": list(warnings or []),
        "fileFormat": file_format,
        "rowSchema": df.schema.json(),
    }
    schema = (
        "metadata string, summary string, validationErrors array<string>, processingWarnings array<string>, "
        "fileFormat string, rowSchema string"
    )
    df.sparkSession.createDataFrame([tuple(row.values())], schema).coalesce(1).write.json(f"{target}/summary")
    return target


def csv_view(df: DataFrame) -> DataFrame:
    """Differences in the fixed CSV column order of their layout."""
    layout = RULESET_CSV_LAYOUT if {"diffType", "primaryId"} & set(df.columns) else LEGACY_CSV_LAYOUT
    # A rule-set column falls back to its legacy name.
    fallback = {"diffType": "type", "primaryId": "id", "message": "note"}

    def value(name: str):
        names = [n for n in (name, fallback.get(name)) if n in df.columns]
        return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names], F.lit("")).alias(name)

    return df.select(*[value(name) for name in layout])


def write_diff_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Quoted CSV with doubled quotes; part files unless one file is asked for."""
    view = csv_view(df)
    if single_file:
        view = view.coalesce(1)

    def write(target: str) -> None:
        view.write.mode("error").csv(target, header=True, quoteAll=True, escape='"', emptyValue="")

    return _write_new(write, path)
