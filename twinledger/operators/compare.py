"""Two-sided comparison: presence, pairs, classification, duplicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.functions.values import Val, literal_for, value_at_path, values_differ
from twinledger.model import (
    MISSING_DIFF_SCHEMA,
    MISSING_IN_1,
    MISSING_IN_2,
    RULESET_DIFF_COLUMNS,
    ConfigError,
)
from twinledger.operators.skew import HOT_ROWS, hot_keys, join_unique
from twinledger.session import ensure_checkpoint_dir

KEY = "compare_id"


# --- presence ----------------------------------------------------------------


def presence(left: DataFrame, right: DataFrame, keys: str | list[str] = KEY) -> DataFrame:
    """One row per id with its row count on each side.

    Both sides are tagged, appended and aggregated once.  Counts combine
    before the shuffle, so an id that fills a third of a side costs one row
    per task, where a join would send all of it to one place.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tagged = left.select(*names, one.alias("in_left"), none.alias("in_right")).unionByName(
        right.select(*names, none.alias("in_left"), one.alias("in_right"))
    )
    return tagged.groupBy(*names).agg(F.sum("in_left").alias("n_left"), F.sum("in_right").alias("n_right"))


def only_in_left(left: DataFrame, right: DataFrame) -> DataFrame:
    return presence(left, right).filter("n_left > 0 AND n_right = 0").select(KEY)


def only_in_right(left: DataFrame, right: DataFrame) -> DataFrame:
    return presence(left, right).filter("n_right > 0 AND n_left = 0").select(KEY)


def matched_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    return presence(left, right).filter("n_left > 0 AND n_right > 0").select(KEY)


def diff_summary(ids: DataFrame) -> DataFrame:
    """One row of totals over a ``presence`` frame.

    Ids and rows are both reported: with duplicated ids a side emits one
    difference per record, so the two numbers may differ.
    """
    only1 = (F.col("n_left") > 0) & (F.col("n_right") == 0)
    only2 = (F.col("n_right") > 0) & (F.col("n_left") == 0)

    def count(condition: Column) -> Column:
        return F.count_if(condition).cast("bigint")

    missing_bytes = F.sum(F.when(only1 | only2, F.octet_length(KEY)))
    return ids.agg(
        F.coalesce(missing_bytes, F.lit(0)).cast("bigint").alias("missing_bytes"),
        count(only1).alias("only_in_file1"),
        count(only2).alias("only_in_file2"),
        count(only1 | only2).alias("missing_total"),
        count((F.col("n_left") > 0) & (F.col("n_right") > 0)).alias("matched"),
        F.coalesce(F.sum(F.when(only1, F.col("n_left")).when(only2, F.col("n_right"))), F.lit(0))
        .cast("bigint").alias("missing_rows"),
        count(F.col("n_left") > 1).alias("duplicated_in_file1"),
        count(F.col("n_right") > 1).alias("duplicated_in_file2"),
    )


def settle(ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The part of a ``presence`` frame later steps need, in the shared folder.

    Missing ids and hot ids survive lost executors as a checkpoint; the many
    plain matches are dropped.
    """
    ensure_checkpoint_dir(ids.sparkSession)
    missing = (F.col("n_left") == 0) | (F.col("n_right") == 0)
    hot = (F.col("n_left") >= hot_rows) | (F.col("n_right") >= hot_rows)
    return ids.filter(missing | hot).checkpoint()


# --- missing rows ------------------------------------------------------------


def word_label(label: str | None, fallback: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "", label or "") or fallback


def missing_row(diff_type: str, id_col: Column, present: str, missing: str, data: Column) -> list[Column]:
    return [
        F.lit(diff_type).alias("type"),
        id_col.alias("id"),
        F.lit(present).alias("presentIn"),
        F.lit(missing).alias("missingIn"),
        data.alias("data"),
        F.lit(f"Present in {present}, missing in {missing}").alias("note"),
    ]


def hot_ids(ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ids of a ``presence`` frame that are hot on either side: one list for both, from the counts as they are."""
    return hot_keys(ids.withColumn("_most", F.greatest("n_left", "n_right")), KEY, "_most", hot_rows)


def missing_diff_rows(
    data: DataFrame, missing: DataFrame, diff_type: str, present_label: str, missing_label: str,
    hot: DataFrame | None = None, small: bool = False,
) -> DataFrame:
    """Every record whose id is in ``missing`` (unique ids), with its payload.

    ``small`` says the caller has measured the ids as fit to broadcast: then
    no payload is shuffled at all.
    """
    wanted = missing.select(KEY)
    if small:
        rows = data.join(F.broadcast(wanted), KEY, "left_semi")
    else:
        # Of unique ids an inner join keeps the same rows; a semi join would be planned below the spreading.
        rows = join_unique(data, wanted.distinct(), KEY, "inner", hot, spread=True)
    return rows.select(
        *missing_row(diff_type, F.col(KEY), present_label, missing_label, F.to_json("data"))
    )


def missing_on_both_sides(
    data1: DataFrame, data2: DataFrame, ids: DataFrame, label1: str, label2: str,
    labelled: bool = False, hot_rows: int = HOT_ROWS, small: bool = False,
) -> DataFrame:
    """Missing rows of both sides; duplicates of an id all appear.

    ``labelled`` names types after the other side (``missing_in_<label>``).
    """
    type1 = f"missing_in_{word_label(label2, 'file2')}" if labelled else MISSING_IN_2
    type2 = f"missing_in_{word_label(label1, 'file1')}" if labelled else MISSING_IN_1
    only1 = ids.filter("n_left > 0 AND n_right = 0")
    only2 = ids.filter("n_right > 0 AND n_left = 0")
    hot = hot_ids(ids, hot_rows)
    return union_missing(
        missing_diff_rows(data1, only1, type1, label1, label2, hot, small),
        missing_diff_rows(data2, only2, type2, label2, label1, hot, small),
    )


def union_missing(a: DataFrame | None, b: DataFrame | None, spark=None) -> DataFrame:
    """Positional bag union; either side may be absent, an empty frame if both are."""
    if a is not None and b is not None:
        return a.union(b)
    if a is not None or b is not None:
        return a if a is not None else b
    return spark.createDataFrame([], MISSING_DIFF_SCHEMA)


def to_ruleset_diff(missing: DataFrame, scope_id: str | None, object_type: str | None) -> DataFrame:
    """The six-column missing layout in the thirteen-column one."""
    source = {"diffType": "type", "primaryId": "id", "message": "note",
              "presentIn": "presentIn", "missingIn": "missingIn", "data": "data"}
    constant = {"compareScopeId": scope_id, "objectType": object_type}
    columns = [
        F.col(source[name]) if name in source else F.lit(constant.get(name)).cast("string")
        for name in RULESET_DIFF_COLUMNS
    ]
    return missing.select(*[c.alias(n) for c, n in zip(columns, RULESET_DIFF_COLUMNS)])


def union_diffs(a: DataFrame | None, b: DataFrame | None) -> DataFrame:
    if a is None or b is None:
        return b if a is None else a
    return a.unionByName(b)


# --- pairs -------------------------------------------------------------------


def matched_pairs(data1: DataFrame, data2: DataFrame, scope_id: str | None, object_type: str | None) -> DataFrame:
    """One row per matched id with both payloads; ids are unique per side."""
    left = data1.select(F.col(KEY), F.col("data").alias("file1"))
    right = data2.select(F.col(KEY), F.col("data").alias("file2"))
    return left.join(right, KEY).select(
        F.lit(scope_id).cast("string").alias("compareScopeId"),
        F.lit(object_type).cast("string").alias("objectType"),
        F.col(KEY).alias("primaryId"),
        "file1",
        "file2",
    )


def tag_sides(data1: DataFrame, data2: DataFrame) -> DataFrame:
    """Full outer join on the id: the single shuffle both missing rows and pairs need."""
    left = data1.select(F.col(KEY), F.col("data").alias("file1"), F.lit(True).alias("in1"))
    right = data2.select(F.col(KEY), F.col("data").alias("file2"), F.lit(True).alias("in2"))
    return left.join(right, KEY, "full_outer").select(
        F.col(KEY).alias("primaryId"), "file1", "file2",
        F.coalesce("in1", F.lit(False)).alias("in1"), F.coalesce("in2", F.lit(False)).alias("in2"),
    )


def full_outer_classify(
    data1: DataFrame, data2: DataFrame, fields: dict[str, str] | list[str]
) -> DataFrame:
    """Per id: MATCH, MISMATCH, MISSING_IN_FILE_1 or MISSING_IN_FILE_2.

    ``fields`` maps a path in side 1 to the path compared in side 2; only
    those fields travel through the shuffle.
    """
    pairs = fields if isinstance(fields, dict) else {f: f for f in fields}
    payload1 = Val(F.col("file1"), data1.schema["data"].dataType)
    payload2 = Val(F.col("file2"), data2.schema["data"].dataType)
    differs = F.lit(False)
    for path1, path2 in pairs.items():
        differs = differs | values_differ(value_at_path(payload1, path1), value_at_path(payload2, path2))
    status = (
        F.when(~F.col("in1"), MISSING_IN_1).when(~F.col("in2"), MISSING_IN_2)
        .when(differs, "MISMATCH").otherwise("MATCH")
    )
    return tag_sides(data1, data2).select("primaryId", status.alias("status"))


# --- duplicates --------------------------------------------------------------


def find_duplicate_ids(data: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` ids that occur more than once, with their counts."""
    limit = n if n > 0 else 5
    return (
        data.groupBy(KEY).agg(F.count(F.lit(1)).alias("row_count"))
        .filter(F.col("row_count") > 1).orderBy(KEY).limit(limit)
    )


def duplicate_examples(duplicates: DataFrame) -> str:
    return ", ".join(f"{row[KEY]} ({row['row_count']} rows)" for row in duplicates.collect())


def validate_unique_ids(data: DataFrame, scope_label: str | None, side: str | None, label: str | None) -> None:
    """Fail when an id names more than one record of a side."""
    examples = duplicate_examples(find_duplicate_ids(data))
    if examples:
        raise ConfigError(duplicate_message(scope_label, side, label, examples))


def duplicate_message(scope_label: str | None, side: str | None, label: str | None, examples: str) -> str:
    scope, code = (scope_label or "").strip() or "compare scope", (side or "").strip() or "FILE"
    name = (label or "").strip() or code
    return (
        f"Compare scope '{scope}' {code} ({name}) produced duplicate primaryId values after "
        f"normalization: {examples}. primaryId must identify exactly one object per file side."
    )


def collapse_duplicates(data: DataFrame) -> DataFrame:
    """One payload per id: the one whose JSON text sorts first, so reruns agree."""
    return data.groupBy(KEY).agg(F.min_by("data", F.to_json("data")).alias("data"))


# --- joins and counts over prepared tables -----------------------------------


def detail_item_join(
    detail: DataFrame, items: DataFrame | None, item_col: str, location_col: str, date_col: str,
    item: object, location: object, start: object, end: object,
) -> DataFrame:
    """Detail rows of one item and location in ``[start, end)``.

    With ``items`` the detail must belong to a known item; the filters are
    applied to both inputs before the join.
    """
    dtype = detail.schema[date_col].dataType
    wanted = detail.filter(
        (F.col(item_col) == F.lit(item)) & (F.col(location_col) == F.lit(location))
        & (F.col(date_col) >= literal_for(start, dtype)) & (F.col(date_col) < literal_for(end, dtype))
    )
    if items is None:
        return wanted
    # Filtered to one item and counted, this side is a single row by
    # construction: the detail rows stay where they were read.
    known = items.filter(F.col(item_col) == F.lit(item)).groupBy(item_col).agg(
        F.count(F.lit(1)).cast("int").alias("_copies")
    )
    return (
        wanted.join(F.broadcast(known), item_col)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*detail.columns)
    )


def classify_counts(a: DataFrame, b: DataFrame, keys: list[str], error_a: Column | None = None,
                    error_b: Column | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Record counts of both sides per key and the status they imply.

    ``expected`` lists keys that should have records; one that has none on
    either side is ``NO_RECORDS``.  Its repeated keys count once.
    """

    def tagged(df: DataFrame, left: int, right: int, error: Column | None = None) -> DataFrame:
        flag = F.lit(False) if error is None else F.coalesce(error, F.lit(False))
        return df.select(*keys, F.lit(left).cast("bigint").alias("a"), F.lit(right).cast("bigint").alias("b"), flag.alias("failed"))

    rows = tagged(a, 1, 0, error_a).unionByName(tagged(b, 0, 1, error_b))
    if expected is not None:
        rows = rows.unionByName(tagged(expected, 0, 0))
    counts = rows.groupBy(*keys).agg(
        F.sum("a").alias("left_count"), F.sum("b").alias("right_count"), F.max("failed").alias("failed")
    )
    return counts.select(*keys, "left_count", "right_count", count_status("left_count", "right_count", "failed"))


def count_status(left: str, right: str, failed: str) -> Column:
    """The six count states, first match wins."""
    a, b = F.col(left), F.col(right)
    return (
        F.when(F.col(failed), "ERROR")
        .when((a == 0) & (b == 0), "NO_RECORDS")
        .when((a == 0) & (b > 0), "MISSING_IN_NS")
        .when((a > 0) & (b == 0), "MISSING_IN_READ_DB")
        .when(a != b, "COUNT_MISMATCH")
        .otherwise("MATCHED_COUNT")
        .alias("compare_status")
    )
