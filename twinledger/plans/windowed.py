"""Reconciliation of many time windows in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.model import CompareScope, MISSING_IN_1, MISSING_IN_2, STATUS_NO_DATA, STATUS_SUCCESS
from twinledger.operators.compare import KEY, presence
from twinledger.operators.windows import tag_windows
from twinledger.plans.reconcile import reconcile_ruleset

SEPARATOR = "\u0001"
"""Stands between a window and an id while both are one key."""


def window_presence(
    a: DataFrame, b: DataFrame, windows: DataFrame, ts_a: str, ts_b: str, id_col: str = "window_id"
) -> DataFrame:
    """Per window and id, the record counts of both sides.

    All windows share one aggregation on (window, id): nothing loops, and a
    window holding most of the data is still spread by its ids.
    """
    left = tag_windows(a.select(KEY, ts_a), ts_a, windows, id_col)
    right = tag_windows(b.select(KEY, ts_b), ts_b, windows, id_col)
    return presence(left, right, [id_col, KEY])


def windowed_diffs(ids: DataFrame, id_col: str = "window_id") -> DataFrame:
    """Missing ids per window; a window with an empty side has no data and gives no rows."""
    kind = F.when(F.col("n_right") == 0, MISSING_IN_2).when(F.col("n_left") == 0, MISSING_IN_1)
    both = ids.groupBy(id_col).agg(F.max("n_left").alias("_l"), F.max("n_right").alias("_r")).filter("_l > 0 AND _r > 0").select(id_col)
    # One row per window; a window with very many ids is split on its own side by adaptive execution.
    return ids.select(id_col, KEY, kind.alias("diffType")).filter(F.col("diffType").isNotNull()).join(both, id_col, "left_semi")


def windowed_reconcile(
    a: DataFrame, b: DataFrame, windows: DataFrame, ts_a: str, ts_b: str, id_col: str = "window_id"
) -> DataFrame:
    """One row per window: status and counts; an empty side means no data.

    Every window appears, also those without records on either side.
    """
    ids = window_presence(a, b, windows, ts_a, ts_b, id_col)
    only1 = (F.col("n_left") > 0) & (F.col("n_right") == 0)
    only2 = (F.col("n_right") > 0) & (F.col("n_left") == 0)
    counts = ids.groupBy(id_col).agg(
        F.sum("n_left").alias("file1_count"),
        F.sum("n_right").alias("file2_count"),
        F.count_if(only1).alias("only_in_file1"),
        F.count_if(only2).alias("only_in_file2"),
        F.count_if(~only1 & ~only2).alias("matched"),
    )
    full = windows.join(counts, id_col, "left")

    def number(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    has_data = (number("file1_count") > 0) & (number("file2_count") > 0)

    def when_data(name: str):
        return F.when(has_data, number(name)).otherwise(F.lit(0).cast("bigint")).alias(name)

    return full.select(
        *windows.columns,
        F.when(has_data, STATUS_SUCCESS).otherwise(STATUS_NO_DATA).alias("statusEnumId"),
        number("file1_count").alias("file1_count"),
        number("file2_count").alias("file2_count"),
        when_data("only_in_file1"),
        when_data("only_in_file2"),
        when_data("matched"),
    )


def windowed_ruleset(
    a: DataFrame, b: DataFrame, windows: DataFrame, ts_a: str, ts_b: str, scope: CompareScope, id_col: str = "window_id"
) -> DataFrame:
    """The whole rule-set compare of every window: its id beside the thirteen columns.

    ``a`` and ``b`` are ``(compare_id, data)`` with a time.  Window and id are
    one key for the compare, so all windows take one run of it; windows with
    an empty side have no data and give no rows.  Ids must be unique within a
    window.
    """
    left, right = tag_windows(a, ts_a, windows, id_col), tag_windows(b, ts_b, windows, id_col)
    both = left.select(id_col).distinct().join(right.select(id_col).distinct(), id_col)  # one row per window

    def keyed(side: DataFrame) -> DataFrame:
        key = F.concat(F.col(id_col).cast("string"), F.lit(SEPARATOR), F.col(KEY))
        return side.join(both, id_col, "left_semi").select(key.alias(KEY), "data")

    diffs = reconcile_ruleset(keyed(left), keyed(right), scope, count=False).diffs
    window = F.substring_index("primaryId", SEPARATOR, 1).cast(windows.schema[id_col].dataType)
    own = F.substr("primaryId", F.instr("primaryId", SEPARATOR) + 1)
    return diffs.select(window.alias(id_col), *[own.alias(c) if c == "primaryId" else F.col(c) for c in diffs.columns])
