"""Removal of byte strings that an earlier document already has, by prefix doubling.

A byte goes when a string of ``length`` bytes that covers it also starts in a
document with a smaller id.  Suffixes are ranked as in prefix doubling, at
growing offsets, and Spark's shuffled sorts bring equal ranks together:

1. Rank at ``SEED`` bytes.  (rank, document) pairs are sorted; positions whose
   rank no other document has are settled as unique and never looked at again.
2. The others are reranked with what lies around them, up to the threshold:
   (rank, document) pairs are sorted again, and within a rank each string of
   ``length`` bytes is compared, so its first document is known.

Only sampled suffixes take part.  Of each string of ``length`` bytes the
position whose ``SEED`` bytes hash lowest stands for it (the first on ties).
That choice depends on the string alone, so equal strings are represented at
equal places, and about one suffix in seventeen is enough to compare them all.
Sorting every suffix needs over a hundred bytes of shuffle for a byte of text.

No step gathers a frequent string: before the first sort each block of texts
sends a rank once, however many of its documents have it; ranks with very many
rows (``hot_rows``) skip the second sort and are compared string by string in a
grouped minimum, which combines before its shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from llm.common import blocks, fresh, mixed, runs_expanded, utf8, written

LENGTH = 50
SEED = 16
HOT_ROWS = 100_000
"""Rows of one rank above which its strings are compared by a grouped minimum; below it a rank takes some 100 MB of a task at most."""
MOST_HOT = 100_000
"""Ranks told to every task at most; those above ``1 / MOST_HOT`` of the frequent ones' rows."""
CHUNK = 16_384
PIECE_BYTES = 1 << 17
NO_ID = -(1 << 63)
"""A null id counts as smaller than any other."""

KEPT = np.uint64(0xFFFFFFFFFFFF0000)
"""48 bits name a rank; two strings under one name are told apart by their bytes."""

ODD = np.random.default_rng(11).integers(1, 1 << 62, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``seed`` bytes from each position, from the 8-byte words that start there."""
    count = len(data) - seed + 1
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    if seed < 8:
        return mixed((words[:count] & np.uint64((1 << 8 * seed) - 1)) * ODD[0])
    out = words[:count] * ODD[0]
    for i, at in enumerate([*range(8, seed - 7, 8), *([seed - 8] if seed % 8 else [])]):
        out = (out ^ (out >> np.uint64(32))) * ODD[1] + words[at : at + count] * ODD[i % 4 + 2]
    return mixed(out)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of strings that share their representing position: ``row, first, many, anchor, rank`` arrays.

    ``first`` is the place of the run's first string and ``many`` their
    number; places are those in ``data``.  Work goes in pieces of bounded size
    (a run may be cut there), small enough for a processor's cache.
    """
    rows = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    for begin in range(0, max(len(data) - length + 1, 0), PIECE_BYTES):
        piece = data[begin : begin + PIECE_BYTES + length - 1]
        rank = seed_hashes(piece, seed)
        low = (rank & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rank), dtype=np.uint64)
        span, width = length - seed + 1, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = rows[begin : begin + len(anchor)]
        whole = row == rows[begin + length - 1 : begin + length - 1 + len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(anchor)))
        good = whole[start]
        start, many = start[good], many[good]
        at = anchor[start]
        yield row[start].astype(np.int64), start + begin, many, at + begin, (rank[at] & KEPT).view(np.int64)


def _ranked(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """``rank, text_key, n`` of a block of ``text_key, text`` rows.

    A rank that one text of the block has: ``n`` is its number there.
    A rank that several have: one row with ``n`` below zero to tell others,
    and for each text a row with ``n`` zero that is settled already.
    """
    for block in blocks(batches, 1):
        ids = block.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [(row, rank) for row, _, _, _, rank in anchors(*utf8(block.column(1)), length, seed)]
        if not found:
            continue
        row, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = ids[row]
        order = np.lexsort((doc, rank))
        rank, doc = rank[order], doc[order]
        head = np.ones(len(rank), bool)
        head[1:] = (rank[1:] != rank[:-1]) | (doc[1:] != doc[:-1])
        times = np.diff(np.append(np.flatnonzero(head), len(rank)))
        rank, doc = rank[head], doc[head]
        if not len(rank):
            continue
        lead = np.concatenate(([True], rank[1:] != rank[:-1]))
        at = np.flatnonzero(lead)
        docs = np.diff(np.append(at, len(rank)))
        total = np.add.reduceat(times, at)
        shared = np.repeat(docs > 1, docs)
        n = np.where(docs > 1, -total, total)
        rank, doc, n = np.concatenate((rank[at], rank[shared])), np.concatenate((doc[at], doc[shared])), np.concatenate((n, np.zeros(int(shared.sum()), np.int64)))
        together = np.argsort(doc, kind="stable")  # rows of a text side by side take less room in the shuffle
        yield pa.RecordBatch.from_arrays([pa.array(x[together]) for x in (rank, doc, n)], names=["rank", "text_key", "n"])


def _grouped(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Sorted batches regrouped so that equal values of a column are never parted."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key = joined.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield joined.slice(0, cut)
        held, rows = [joined.slice(cut)], len(key) - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _shared(batches: Iterator[pa.RecordBatch], hot_rows: int) -> Iterator[pa.RecordBatch]:
    """From sorted ``rank, text_key, n``: the pairs whose rank several texts have; ranks with many rows with a null key."""
    for part in _grouped(batches, 0):
        rank, doc, n = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        at = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        size = np.diff(np.append(at, len(rank)))
        several = (np.add.reduceat((n != 0).astype(np.int64), at) > 1) | (np.minimum.reduceat(n, at) < 0)
        keep = (n == 0) | ((n > 0) & np.repeat(several, size))
        total = np.add.reduceat(np.abs(n), at)
        hot = several & (total > hot_rows)
        gone = int(hot.sum())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((rank[keep], rank[at[hot]]))),
            pa.concat_arrays([pa.array(doc[keep], pa.int64()), pa.nulls(gone, pa.int64())]),
            pa.array(np.concatenate((np.zeros(int(keep.sum()), np.int64), total[hot])))], names=["rank", "text_key", "n"])


RUN = StructType([StructField(c, LongType()) for c in ("rank", "doc", "text_key", "place")]).add("bytes", "binary")
"""A run; ``place`` has its first string's place in the text, their number and the anchor's distance, 32, 16 and 16 bits."""
WHOLE = -1
"""``many`` of a text that an earlier document has as a whole."""


def _surroundings(batches: Iterator[pa.RecordBatch], length: int, seed: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of ``doc, text, text_key, ranks`` rows: each run whose rank is listed, with the bytes its strings cover."""
    for block in blocks(batches, 1):
        data, ends = utf8(block.column(1))
        ids, keys = (block.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
        lists = block.column(3)
        listed = np.asarray(lists.flatten()).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()).astype(np.int64))
        wanted = np.unique(mixed(listed.view(np.uint64)) + owner.astype(np.uint64))
        if not len(wanted):
            continue
        for row, first, many, anchor, rank in anchors(data, ends, length, seed):
            pair = mixed(rank.view(np.uint64)) + row.astype(np.uint64)
            good = wanted[np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)] == pair
            if len(hot):
                good &= hot[np.minimum(np.searchsorted(hot, rank), len(hot) - 1)] != rank
            row, first, many, anchor, rank = (x[good] for x in (row, first, many, anchor, rank))
            size = many + length - 1
            flat = data[np.repeat(first, size) + runs_expanded(size)]
            cuts = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([
                pa.array(rank), pa.array(ids[row]), pa.array(keys[row]), pa.array((first - ends[row]) << 32 | many << 16 | (anchor - first)), held,
            ], names=RUN.names)


def _repeats(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """From runs sorted by rank and document: the strings that a smaller document has, as ``doc, text_key, first, many``."""
    reach = length - seed
    base = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(pow(int(base), length, 1 << 64))
    for part in _grouped(batches, 0, CHUNK):
        rank, doc, key, place = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        first, many, left = place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF
        held = part.column(4)
        cuts = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        flat = np.frombuffer(held.buffers()[2], np.uint8)
        size = np.diff(cuts)
        n = len(rank)
        wide = np.zeros((n, 2 * reach + seed), np.uint8)  # every row's anchor stands in column `reach`
        wide[np.repeat(np.arange(n), size), np.repeat(reach - left, size) + runs_expanded(size)] = flat[cuts[0] : cuts[-1]]
        sums = np.zeros((wide.shape[1] + 1, n), np.uint64)
        for c in range(wide.shape[1]):
            sums[c + 1] = sums[c] * base + wide[:, c] + np.uint64(1)
        group = np.cumsum(np.concatenate(([0], rank[1:] != rank[:-1]))).astype(np.uint64) * ODD[1]
        dup = np.zeros((n, reach + 1), bool)
        for start in range(reach + 1):  # the string starts in this column
            j = start - reach + left  # its number in the row's run
            at = np.flatnonzero((j >= 0) & (j < many))
            if len(at) < 2:
                continue
            value = mixed(sums[start + length, at] - sums[start, at] * shift) ^ group[at]
            _, lead, back = np.unique(value, return_index=True, return_inverse=True)
            ref = at[lead[back]]  # rows are in the order of their documents
            other = np.flatnonzero(ref != at)
            same = (wide[at[other], start : start + length] == wide[ref[other], start : start + length]).all(1) & (rank[at[other]] == rank[ref[other]])
            if not same.all():  # a hash that two strings share: compare the strings themselves
                strings = [(int(rank[i]), wide[i, start : start + length].tobytes()) for i in at]
                smallest: dict = {}
                ref = np.array([smallest.setdefault(s, i) for s, i in zip(strings, at, strict=True)])
            dup[at, start] = doc[ref] < doc[at]
        edge = np.diff(np.pad(dup, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays([
            pa.array(doc[row]), pa.array(key[row]), pa.array(first[row] + begin - reach + left[row]), pa.array(end - begin)],
            names=["doc", "text_key", "first", "many"])


def _strings(batches: Iterator[pa.RecordBatch], length: int, seed: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of ``doc, text, text_key`` rows: every string of a frequent rank, named by 128 bits."""
    for block in blocks(batches, 1):
        data, ends = utf8(block.column(1))
        ids, keys = (block.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
        for row, first, many, _, rank in anchors(data, ends, length, seed):
            good = hot[np.minimum(np.searchsorted(hot, rank), len(hot) - 1)] == rank
            row, first, many = row[good], first[good], many[good]
            row, first = np.repeat(row, many), np.repeat(first, many) + runs_expanded(many)
            names = [hashlib.blake2b(data[a : a + length], digest_size=16).digest() for a in first.tolist()]
            both = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids[row]), pa.array(keys[row]), pa.array(first - ends[row])],
                                             names=["a", "b", "doc", "text_key", "first"])


def _shared_ranks(base: DataFrame, length: int, seed: int, hot_rows: int) -> DataFrame:
    """``rank, text_key`` pairs of ranks that several texts have."""
    ranked = base.select("h", "t").mapInArrow(lambda it: _ranked(it, length, seed), "rank long, text_key long, n long")
    # A settled pair goes anywhere; a rank's other rows, one for each block of texts at most, meet.
    ranked = ranked.repartition(F.when(F.col("n") == 0, F.xxhash64("rank", "text_key")).otherwise(F.col("rank"))).sortWithinPartitions("rank", "text_key")
    return ranked.mapInArrow(lambda it: _shared(it, hot_rows), "rank long, text_key long, n long")


def _cut(text: bytes, first: list[int], many: list[int], length: int) -> tuple[bytes, int, int]:
    """What is left of a text, the removed bytes and the maximal removed runs."""
    if WHOLE in many:
        return b"", len(text), 1
    edge = np.zeros(len(text) + 1, np.int64)
    start = np.array(first, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.array(many, np.int64) - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, length: int = LENGTH,
                   seed: int | None = None, hot_rows: int = HOT_ROWS, kept_text: str | None = None) -> DataFrame:
    """Columns ``keep`` (default: the id) of ``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256``.

    With ``kept_text`` that column holds the text that is left (bytes that no
    longer form a character are dropped; null stays null).  Null and short texts lose nothing;
    a null text counts as empty.  A null id is smaller than all others, and
    rows that repeat an id aren't smaller than each other.  Every row of
    ``docs`` gives one row, an empty table none; columns may have any names.
    """
    if not 2 <= length < 1 << 16:
        raise ValueError("length must be from 2 to 65,535")
    seed = min(SEED, max(1, length // 3)) if seed is None else seed
    keep = [doc_id] if keep is None else keep
    key = F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID))
    base = docs.select(key.alias("k"), F.xxhash64(docs[text].cast("string")).alias("h"), docs[text].cast("string").alias("t"),
                       *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)])
    keyed = base.select("k", F.col("h").alias("text_key"), F.xxhash64(F.lit(1), "t").alias("check"), F.octet_length("t").alias("size"))
    # Equal texts are compared once: the first of them stands for all, the others are whole repeats.
    firsts = keyed.groupBy("text_key", "check").agg(F.min("k").alias("k"))

    shared = written(_shared_ranks(base, length, seed, hot_rows), "suffix-shared")
    often = shared.where(F.col("text_key").isNull())
    rows = often.agg(F.sum("n")).first()[0] or 0
    hot = np.array(sorted(r[0] for r in often.where(F.col("n") > rows / MOST_HOT).select("rank").collect()), np.int64)

    lists = shared.where(F.col("text_key").isNotNull()).groupBy("text_key").agg(F.collect_set("rank").alias("ranks"))
    lists = lists.join(firsts.select("text_key", F.col("k").alias("doc")), "text_key")
    # All of base's columns and the same keys, so that this exchange of the texts serves the last join as well.
    near = base.join(lists, (F.col("k") == F.col("doc")) & (F.col("h") == F.col("text_key"))).select(
        "k", "t", "text_key", "ranks", *[f"c{i}" for i in range(len(keep))])
    runs = near.mapInArrow(lambda it: _surroundings(it, length, seed, hot), RUN)
    repeats = runs.repartition("rank").sortWithinPartitions("rank", "doc").mapInArrow(
        lambda it: _repeats(it, length, seed), "doc long, text_key long, first long, many long")
    if len(hot):
        strings = written(base.select("k", "t", "h").mapInArrow(
            lambda it: _strings(it, length, seed, hot), "a long, b long, doc long, text_key long, first long"), "suffix-strings")
        lowest = strings.groupBy("a", "b").agg(F.min("doc").alias("lowest"))
        more = strings.join(lowest, ["a", "b"]).where("lowest < doc").select("doc", "text_key", "first", F.lit(1).cast("long").alias("many"))
        repeats = repeats.unionByName(more)
    copies = keyed.where(F.col("size") >= length).join(firsts.withColumnRenamed("k", "lowest"), ["text_key", "check"]).where("lowest < k").select(
        F.col("k").alias("doc"), "text_key", F.lit(0).cast("long").alias("first"), F.lit(WHOLE).cast("long").alias("many")).distinct()
    found = repeats.unionByName(copies).groupBy("doc", "text_key").agg(F.collect_list(F.struct("first", "many")).alias("found"))

    joined = base.join(found, (F.col("k") == F.col("doc")) & (F.col("h") == F.col("text_key")), "left").select(
        *[f"c{i}" for i in range(len(keep))], "t", "found")
    n = len(keep)
    added = [StructField(c, LongType(), False) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType(), False)]
    if kept_text:
        added.append(StructField(kept_text, StringType()))
    schema = StructType([StructField(c, docs.schema[c].dataType) for c in keep] + added)
    names = schema.names

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, n):
            data, ends = utf8(block.column(n))
            lists = block.column(n + 1)
            many = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            items = lists.flatten()
            first, count = (np.asarray(items.field(i)).astype(np.int64) for i in (0, 1))
            cuts = np.concatenate(([0], np.cumsum(many)))
            out: list[tuple] = []
            null = block.column(n).is_null().to_pylist()
            view = data.tobytes()
            for i in range(block.num_rows):
                own = view[ends[i] : ends[i + 1]]
                left, gone, spans = _cut(own, first[cuts[i] : cuts[i + 1]], count[cuts[i] : cuts[i + 1]], length) if many[i] else (own, 0, 0)
                row = (len(own), gone, spans, hashlib.sha256(left).hexdigest())
                out.append((*row, None if null[i] else left.decode("utf-8", "ignore")) if kept_text else row)
            made = [pa.array(list(x), pa.int64() if i < 3 else pa.string()) for i, x in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays([block.column(i) for i in range(n)] + made, names=names)

    return joined.mapInArrow(finish, schema)


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated strings cut from the text; a null text stays null, all columns and rows stay."""
    left = fresh(docs, "_kept")
    told = remove_repeats(docs, doc_id, text, keep=[c for c in docs.columns if c != text], kept_text=left)
    return told.select(*[F.col(f"`{left}`").alias(text) if c == text else told[c] for c in docs.columns])
