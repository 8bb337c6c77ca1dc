"""Joins of a possibly skewed frame with one that is unique per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot from this many rows on, and at most this many keys are treated
# as hot: the most frequent ones, so their broadcast has a fixed bound.  Keys
# beyond it take the ordinary join; each of them then holds less than one part
# in MAX_HOT_KEYS of all rows, which is no skew.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


# A table of keys is broadcast only while its counted size stays below this.
BROADCAST_BYTES = 256 * 1024 * 1024
ROW_OVERHEAD = 64


def fits_broadcast(rows: int, key_bytes: int) -> bool:
    """Is a key table of this counted size safe to send to every executor."""
    return key_bytes + rows * ROW_OVERHEAD <= BROADCAST_BYTES


def hot_keys(counted: DataFrame, key: str | list[str], count_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The most frequent keys of at least ``hot_rows`` rows, from a pre-aggregated count."""
    names = [key] if isinstance(key, str) else key
    frequent = counted.filter(F.col(count_col) >= hot_rows).orderBy(F.col(count_col).desc(), *names)
    return frequent.limit(MAX_HOT_KEYS).select(*names)


def hot_keys_of(df: DataFrame, key: str | list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``hot_keys`` from the frame itself: one narrow aggregate over its keys."""
    names = [key] if isinstance(key, str) else key
    return hot_keys(df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), names, "_n", hot_rows)


def join_unique(
    big: DataFrame, unique: DataFrame, key: str | list[str], how: str, hot: DataFrame | None = None, spread: bool = False
) -> DataFrame:
    """``big`` inner/semi/left join ``unique`` on ``key`` without a hot task.

    Rows of hot keys stay where they are and meet a broadcast of the few
    matching rows; all others take the ordinary shuffle join.  When no key is
    hot, adaptive execution sees the empty broadcast and drops that branch.

    ``spread`` deals the ordinary join over all shuffle partitions, whatever
    they hold: adaptive execution would merge them up to a size, and a task
    then holds that size in every sort and hash table of the join.
    """
    if hot is None:
        return big.join(unique, key, how)
    few = F.broadcast(hot)
    cold = big.join(few, key, "left_anti")
    if spread:
        names = [key] if isinstance(key, str) else key
        cold = cold.repartition(int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)
    cold_part = cold.join(unique, key, how)
    hot_unique = unique.join(few, key, "left_semi")
    hot_part = big.join(few, key, "left_semi").join(F.broadcast(hot_unique), key, how)
    return cold_part.unionByName(hot_part)
