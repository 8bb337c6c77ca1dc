"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each source partition go to each shard is drawn first, so
that it has the law of a uniform shuffle: row by row, a multivariate
hypergeometric draw from the places that the shards have left.  Then each
partition permutes its own rows, deals them out by its row of the matrix, the
rows are exchanged, and each shard is permuted again.  Shard sizes differ by
one row at most.  Neither step gathers a shard or a frequent id in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import fresh, written

BLOCK_ROWS = 100_000
"""Rows of a shard that one task orders, about."""
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` from ``good + bad`` without replacement, at any size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = 12 + int(12 * np.sqrt(drawn * share * (1 - share)))
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=float)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    p = np.exp(log_p - log_p.max())
    return low + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right"))


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """``[partition, shard]`` counts with the partitions' sizes as row sums and near-equal column sums."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    left = np.full(shards, total // shards, np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(sizes), shards), np.int64)
    for i, rows in enumerate(sizes):
        rest, room = rows, int(left.sum())
        for s in range(shards):
            room -= int(left[s])
            out[i, s] = hypergeometric(rng, int(left[s]), room, rest)
            rest -= int(out[i, s])
        left -= out[i]
    return out


def shuffled(rows: DataFrame, shards: int = 8, seed: int = 42, shard: str = "shard", slot: str = "slot", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All columns of ``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    Every row, repeated ones too, gets exactly one place; columns may be null
    or have any names except the two that are added.  An empty table stays
    empty.  With fewer rows than shards some shards are empty.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    spark = rows.sparkSession
    part, at, first, second, place, cut, block, count, before = (
        fresh(rows, c) for c in ("_part", "_at", "_first", "_second", "_place", "_cut", "_block", "_count", "_before"))
    # Written once: source partitions and random draws are settled, whatever is computed again later.
    staged = written(rows.withColumns({
        part: F.spark_partition_id(), at: F.monotonically_increasing_id(), first: F.rand(seed), second: F.rand(seed + 1)}), "shard-rows")
    sizes = sorted((r[0], r[1]) for r in staged.groupBy(part).agg(F.count("*")).collect())  # a number for each source partition
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    cuts = spark.createDataFrame([(p, [int(x) for x in row]) for (p, _), row in zip(sizes, np.cumsum(matrix, axis=1), strict=True)], f"`{part}` int, `{cut}` array<long>")
    ranked = staged.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(first, at)) - 1).join(cuts, part)
    dealt = ranked.withColumn(shard, F.size(F.filter(cut, lambda c: c <= F.col(place))))
    blocks = max(1, -(-sum(n for _, n in sizes) // (shards * block_rows)))
    dealt = written(dealt.withColumn(block, F.floor(F.col(second) * blocks).cast("int")).drop(place, cut, part, first), "shard-dealt")
    counts = dealt.groupBy(shard, block).agg(F.count("*").alias(count))
    earlier = counts.select(shard, block, (F.sum(count).over(Window.partitionBy(shard).orderBy(block)) - F.col(count)).alias(before))
    slots = dealt.withColumn(place, F.row_number().over(Window.partitionBy(shard, block).orderBy(second, at))).join(earlier, [shard, block])
    return slots.select(*[slots[c] for c in rows.columns], shard, (F.col(before) + F.col(place) - 1).alias(slot))


def write_shards(placed: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, each file in slot order; a shard may have many files."""
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def law(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """The ``rows`` law over documents: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Null texts have no bytes.  Only numbers are moved, not the texts.
    """
    body = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    light = docs.select(docs["doc_id"].alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = shuffled(light, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
