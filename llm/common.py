"""Shared helpers: reading tables, written intermediates, Arrow batch work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from twinledger.session import scratch_path

BLOCK_BYTES = 4 << 20
"""Text bytes that one step of vectorised Python work takes at a time (a longer text comes alone)."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Spark's setting by which an execution's shuffle files go when it ends."""


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    Nothing refers to the shuffles below the table any more, so their files
    are given up at once; the session's own setting comes back afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends.astype(np.int64) - int(ends[0])


def texts(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; null counts as empty."""
    data, ends = utf8(column)
    view = data.tobytes()
    return [view[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def blocks(batches: Iterator[pa.RecordBatch], column: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a column's bytes stay below ``most`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def arrow_type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def with_arrow_columns(df: DataFrame, text: str, keep: list[str], fields: list[StructField],
                       work: Callable[[pa.Array], list]) -> DataFrame:
    """Columns ``keep`` of ``df`` beside new ones that ``work`` makes from the text column, block by block."""
    source = df.select(*[df[c] for c in keep], df[text].cast("string").alias(fresh(df, "_text")))
    schema = StructType([df.schema[c] for c in keep] + fields)
    n = len(keep)
    names = [f.name for f in schema]
    kinds = [arrow_type(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, n):
            made = work(block.column(n))
            new = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(i) for i in range(n)] + new, names=names)

    return source.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit numbers (public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_expanded(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths, concatenated."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shard_of(*columns) -> F.Column:
    """A non-negative hash of columns, for salting."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
