"""Run results, executions and stored differences: lookup, filter, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.functions.values import norm_text, strip_blank
from twinledger.model import (
    STATUS_FAILED,
    STATUS_NO_DATA,
    STATUS_PENDING,
    STATUS_RUNNING,
    STATUS_SKIPPED,
    STATUS_SUCCESS,
)
from twinledger.operators.skew import hot_keys_of, join_unique

# Searched columns, id paths, date-range fields, page bounds.
RESULT_SEARCH_COLUMNS = [
    "fileName", "savedRunId", "savedRunName", "savedRunType", "reconciliationMappingId", "mappingName",
    "ruleSetId", "compareScopeId", "compareScopeDescription", "file1Label", "file2Label",
    "reconciliationType", "statusEnumId", "statusLabel",
]
SAVED_RUN_SEARCH_COLUMNS = [
    "savedRunId", "runName", "description", "companyUserGroupId", "companyLabel", "runType",
    "reconciliationMappingId", "ruleSetId", "compareScopeId", "compareScopeDescription",
]
DIFF_ID_PATHS = [
    "id", "record_id", "recordId", "compare_id", "compareId",
    "data.id", "data.record_id", "data.recordId", "data.compare_id", "data.compareId",
    "data.legacyResourceId", "data.node.legacyResourceId", "data.node.id",
]
RANGE_START_FIELDS = [
    "windowStart", "windowStartUtc", "windowStartDate", "childWindowStart", "childWindowStartDate",
    "windowStartEpochMillis", "fromDate", "dateFrom",
]
RANGE_END_FIELDS = [
    "windowEnd", "windowEndUtc", "windowEndDate", "childWindowEnd", "childWindowEndDate",
    "windowEndEpochMillis", "toDate", "dateTo",
]
PAGE_SIZE = 20
PAGE_SIZE_MAX = 200
RETENTION_DAYS = 15


def tenant_filter(df: DataFrame, tenant: str | None, col: str = "companyUserGroupId") -> DataFrame:
    """Rows owned by the active tenant; no tenant or no owner shows nothing."""
    active = (tenant or "").strip()
    return df.filter(F.col(col) == F.lit(active)) if active else df.filter(F.lit(False))


# --- executions --------------------------------------------------------------


def status_counts(executions: DataFrame, by: str = "automationId") -> DataFrame:
    """Succeeded, no-data, failed and skipped executions per automation."""

    def count(status: str, name: str) -> Column:
        return F.count_if(F.col("statusEnumId") == status).alias(name)

    return executions.groupBy(by).agg(
        count(STATUS_SUCCESS, "executedCount"), count(STATUS_NO_DATA, "noDataCount"),
        count(STATUS_FAILED, "failedCount"), count(STATUS_SKIPPED, "skippedDuplicateCount"),
    )


def _file_name(path: Column) -> Column:
    cleaned = F.rtrim(strip_blank(path), F.lit("/\\"))
    return F.nullif(F.regexp_extract(cleaned, r"([^/\\]+)$", 1), F.lit(""))


def execution_history_enrich(executions: DataFrame, results: DataFrame) -> DataFrame:
    """Result path and file name of each execution: its own, else its run result's.

    Executions that need no lookup get scattered keys that match nothing, so
    they do not meet in one null group.
    """
    own_path = norm_text(F.col("resultDataManagerPath"), blank_to_null=True)
    own_name = norm_text(F.col("resultFileName"), blank_to_null=True)
    linked = results.select(
        "reconciliationRunResultId",
        norm_text(F.col("resultDataManagerPath"), blank_to_null=True).alias("_result_path"),
    )
    needed = F.col("reconciliationRunResultId").isNotNull() & (own_path.isNull() | own_name.isNull())
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in executions.columns]), F.lit(4096)).cast("string")
    keyed = executions.withColumn(
        "_key", F.when(needed, F.col("reconciliationRunResultId")).otherwise(F.concat(F.lit("\x00"), spread))
    )
    unique = linked.withColumnRenamed("reconciliationRunResultId", "_key")
    joined = join_unique(keyed, unique, "_key", "left", hot_keys_of(keyed, "_key"))
    return joined.select(
        *[F.col(c) for c in executions.columns if c not in ("resultDataManagerPath", "resultFileName")],
        F.coalesce(own_path, F.col("_result_path")).alias("resultDataManagerPath"),
        F.coalesce(own_name, _file_name(F.col("_result_path"))).alias("resultFileName"),
    )


def collapse_execution_history(executions: DataFrame, order: list[Column]) -> DataFrame:
    """The first-listed execution per automation and window.

    ``order`` sorts ascending and must be unique.  Executions without a window
    all stay.  The first row is an aggregate, so an automation with a very
    long history combines before the shuffle.
    """
    without_window = F.col("childWindowStart").isNull() & F.col("childWindowEnd").isNull()
    row = F.struct(*[F.col(f"`{c}`") for c in executions.columns])
    keys = ["automationId", "childWindowStart", "childWindowEnd"]
    first = (
        executions.filter(~without_window).groupBy(*keys)
        .agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")
    )
    return first.unionByName(executions.filter(without_window))


def last_run(results: DataFrame, tenant: str | None = None, by_tenant: bool = True) -> DataFrame:
    """Latest result per user (and tenant) by creation time, ties by id."""
    keys = ["createdByUserId"] + (["companyUserGroupId"] if by_tenant else [])
    source = tenant_filter(results, tenant) if tenant else results
    row = F.struct(*[F.col(f"`{c}`") for c in results.columns])
    newest = F.struct("createdDate", "reconciliationRunResultId")
    return source.groupBy(*keys).agg(F.max_by(row, newest).alias("_row")).select("_row.*")


def result_lookup(paths: DataFrame, results: DataFrame, path_col: str = "path") -> DataFrame:
    """Run result of an artifact path: as result, else as input 1, else as input 2.

    The three path columns become one key, reduced to the best claim per path
    before the join, so a file used by very many runs stays one row.
    """
    fields = ["resultDataManagerPath", "file1DataManagerPath", "file2DataManagerPath"]
    claims = F.array(*[
        F.struct(F.col(f).alias("path"), F.lit(i).alias("priority"), F.lit(f).alias("matchedField"))
        for i, f in enumerate(fields)
    ])
    best = (
        results.select("reconciliationRunResultId", F.explode(claims).alias("c"))
        .filter(F.col("c.path").isNotNull()).groupBy(F.col("c.path").alias(path_col))
        .agg(F.min(F.struct("c.priority", "reconciliationRunResultId", "c.matchedField")).alias("m"))
        .select(path_col, F.col("m.reconciliationRunResultId").alias("reconciliationRunResultId"),
                F.col("m.matchedField").alias("matchedField"))
    )
    wanted = paths.filter(F.contains(F.col(path_col), F.lit("/")))
    return join_unique(wanted, best, path_col, "inner", hot_keys_of(wanted, path_col))


# --- manifest ----------------------------------------------------------------


def append_manifest(events: DataFrame, path: str) -> None:
    """Manifest changes are appended; the current state is a view over them."""
    events.write.mode("append").parquet(path)


def latest_manifest(
    events: DataFrame, id_col: str = "reconciliationRunResultId",
    order: tuple[str, ...] = ("lastUpdatedDate",),
) -> DataFrame:
    """Current state per run: for each field its newest value that is not null."""
    when = F.struct(*order)
    fields = [c for c in events.columns if c != id_col]
    return events.groupBy(id_col).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c) for c in fields]
    )


# --- result catalogue --------------------------------------------------------


def _any_contains(columns: list[str], needle: str, available: list[str]) -> Column:
    hit = F.lit(False)
    for name in columns:
        if name in available:
            hit = hit | F.coalesce(F.contains(F.lower(strip_blank(F.col(name))), F.lit(needle)), F.lit(False))
    return hit


def filter_results(df: DataFrame, saved_run_id: str | None = None, query: str | None = None) -> DataFrame:
    """Catalogue filter: exact saved-run id (with its fallbacks) and a substring."""
    wanted, needle = (saved_run_id or "").strip(), (query or "").strip().lower()
    if wanted:
        ids = [F.nullif(F.col(c), F.lit("")) for c in ("savedRunId", "reconciliationMappingId", "ruleSetId")
               if c in df.columns]
        df = df.filter(strip_blank(F.coalesce(*ids)) == wanted)
    return df.filter(_any_contains(RESULT_SEARCH_COLUMNS, needle, df.columns)) if needle else df


def date_range(metadata: Column) -> tuple[Column, Column]:
    """Start and end of a run from its JSON metadata: the first field that is set."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in RANGE_START_FIELDS + RANGE_END_FIELDS])
    parsed = F.from_json(metadata, schema)

    def first(names: list[str]) -> Column:
        values = []
        for name in names:
            text = F.nullif(parsed.getField(name), F.lit(""))
            if name.endswith("EpochMillis"):
                millis = F.timestamp_millis(strip_blank(text).try_cast("bigint"))
                fraction = F.when(F.date_format(millis, "SSS") == "000", "").otherwise(F.date_format(millis, ".SSS"))
                text = F.concat(F.date_format(millis, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
            values.append(text)
        return norm_text(F.coalesce(*values), blank_to_null=True)

    return first(RANGE_START_FIELDS), first(RANGE_END_FIELDS)


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def list_results(
    df: DataFrame, tenant: str | None, saved_run_id: str | None = None, query: str | None = None,
    page: int = 0, size: int = PAGE_SIZE, metadata_col: str | None = None,
) -> tuple[DataFrame, dict]:
    """A page of results, newest first, and its pagination numbers."""
    page, size = max(0, page), min(PAGE_SIZE_MAX, max(1, size))
    rows = filter_results(tenant_filter(df, tenant), saved_run_id, query)
    total = rows.count()
    shown = rows.orderBy(F.col("createdDate").desc(), F.col("reconciliationRunResultId")).offset(page * size).limit(size)
    if metadata_col:
        start, end = date_range(F.col(metadata_col))
        shown = shown.withColumn("rangeStart", start).withColumn("rangeEnd", end)
    return shown, {"pageIndex": page, "pageSize": size, "totalCount": total, "pageCount": page_count(total, size)}


def saved_run_catalog(
    mapping_runs: DataFrame, rule_set_runs: DataFrame, query: str | None = None
) -> DataFrame:
    """Both kinds of saved run in one list ordered by name, then id.

    ``systemLabels`` holds the labels and codes of the run's systems.
    """
    rows = mapping_runs.unionByName(rule_set_runs, allowMissingColumns=True)
    needle = (query or "").strip().lower()
    if needle:
        hit = _any_contains(SAVED_RUN_SEARCH_COLUMNS, needle, rows.columns)
        if "systemLabels" in rows.columns:
            labels = F.lower(F.concat_ws("\n", "systemLabels"))
            hit = hit | F.contains(labels, F.lit(needle))
        rows = rows.filter(hit)
    name = F.coalesce(norm_text(F.col("runName"), True), norm_text(F.col("savedRunId"), True), F.lit(""))
    return rows.orderBy(name, F.coalesce(norm_text(F.col("savedRunId")), F.lit("")))


# --- stored differences ------------------------------------------------------


def _path_type(schema: T.StructType, path: str) -> T.DataType | None:
    current: T.DataType = schema
    for part in path.split("."):
        if not isinstance(current, T.StructType) or part not in current.fieldNames():
            return None
        current = current[part].dataType
    return current


def search_diffs(
    df: DataFrame, query: str | None, diff_type: str | None = None, missing_label: str | None = None
) -> DataFrame:
    """Differences whose id is like ``query``, of a type or missing in a label.

    ``%`` and ``_`` typed by the user are wildcards; other text matches anywhere.
    """
    needle = (query or "").lower()
    pattern = needle if "%" in needle or "_" in needle else f"%{needle}%"
    like = [
        F.coalesce(F.lower(F.col(path).cast("string")).like(pattern), F.lit(False))
        for path in DIFF_ID_PATHS + ["primaryId"]
        if isinstance(_path_type(df.schema, path), T.AtomicType)
    ]
    ids = F.lit(not like)
    for condition in like:
        ids = ids | condition
    if not diff_type:
        return df.filter(ids)
    types = [F.col(c) for c in ("diffType", "type") if c in df.columns]
    kind = F.lower(F.coalesce(*types)) == diff_type.lower() if types else F.lit(False)
    if missing_label and "missingIn" in df.columns:
        kind = kind | (F.lower("missingIn") == missing_label.lower())
    return df.filter(ids & F.coalesce(kind, F.lit(False)))


def paged_search(df: DataFrame, page: int = 0, size: int = PAGE_SIZE) -> tuple[DataFrame, dict]:
    """A page by position; a page past the end falls back to the first.

    The page is a bounded top-n over ``pos``: no row numbering of everything.
    """
    total = df.count()
    index = max(0, page)
    if total > 0 and index * size >= total:
        index = 0
    return df.orderBy("pos").offset(index * size).limit(size), {"total": total, "pageIndex": index}


# --- retention ---------------------------------------------------------------


def retention_partition(
    listing: DataFrame, now, days: int = RETENTION_DAYS, name_col: str = "name", mtime_col: str = "mtime"
) -> DataFrame:
    """Result files with their ``action``: DELETE once older than ``days``, else RETAIN.

    Only CSV and JSON results are considered, and only results are listed, so
    source files are never touched.
    """
    name = F.lower(F.col(name_col))
    results = listing.filter(name.endswith(".csv") | name.endswith(".json"))
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return results.withColumn(
        "action", F.when(F.col(mtime_col) > cutoff, "RETAIN").otherwise("DELETE")
    )


def retention_counts(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count(F.lit(1)).alias("scannedCount"),
        F.count_if(F.col("action") == "DELETE").alias("deletedCount"),
        F.count_if(F.col("action") == "RETAIN").alias("retainedCount"),
    )


# Statuses that mean a run is still going.
ACTIVE_STATUSES = [STATUS_PENDING, STATUS_RUNNING]
