"""Near-duplicate groups by word-shingle similarity: SimHash links from BK-trees, each verified exactly, and what they miss.

Two texts are near copies when the sets of their runs of five words have a
Jaccard similarity of at least 0.8.  A fingerprint has 256 bits, the majority
of its text's runs; near copies at 0.8 differ in 39 bits on average and texts
without common runs in 128, so BK-trees are searched within ``RADIUS`` 64.
Texts that hang together by tree links are compared, and what is verified links
them.

A tree holds fingerprints that agree in one of 16 fields of 16 bits, which
random bits at 0.8 do in 69 of 100 pairs, at 0.9 in 95.  No bit fields are
lossless at such a radius, and a search that is compares all pairs.  So the
links that trees miss are looked for by min-hashes: ``BANDS`` bands of ``ROWS``
minima each, and texts that agree in a whole band share a bucket.  A pair at
similarity 0.8 is in no common bucket with probability (1 - 0.8^5)^60, about
5e-11, a closer one less often.  Buckets tie each text to their first one and,
with the tree links, make loose groups; every link lies within a loose group.
Loose groups that verified SimHash links connect wholly are done.

A block of texts is sent once to a task, which counts what runs its texts share
by an index of them, so no row is made for a pair.  A tree's group of up to
``GROUP_ROWS`` texts is one block; all texts of a larger one meet one block of
it, which links most of what can be linked.  In a loose group that is not yet
one component the texts outside the largest one, in blocks, meet all texts, in
chunks.  That step is exact at every size and reads a group's texts once for
every ``GROUP_ROWS`` of those outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from llm.common import BLOCK_BYTES, blocks, mixed, runs_expanded, texts, with_arrow_columns, written
from llm.components import connected
from llm.simhash import LOWER, SEED, kept_of_groups, majority, wide_links

WORDS = 5
SIMILARITY = (4, 5)
"""0.8 as a fraction, so that the comparison is in whole numbers."""
PRINT_WORDS = 4
"""64-bit words of a fingerprint."""
RADIUS = 64
"""Differing bits, of 256, up to which fingerprints are linked for comparison."""
BANDS, ROWS = 60, 5
GROUP_ROWS, GROUP_BYTES = 512, 8 << 20
"""Size of a block of texts that a task holds; larger groups are compared in several."""
CHUNKS = 8
"""So many blocks' worth of texts pass a held block in one task."""
_draw = np.random.Generator(np.random.PCG64(SEED))
FLIP = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)
TIMES = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
STEP = _draw.integers(0, 1 << 64, BANDS, np.uint64, endpoint=False)
SALT = _draw.integers(0, 1 << 64, PRINT_WORDS, np.uint64, endpoint=False)


def shingles(text: bytes, words: int = WORDS) -> set[bytes]:
    """The runs of ``words`` words, a shorter text as a whole; no words, no runs."""
    parts = text.translate(LOWER).split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(a) + len(b) - both)


def _names(column: pa.Array) -> list:
    """The 64-bit hash of each text's words; null and wordless texts have 0."""
    out = np.zeros(len(column), np.uint64)
    for i, text in enumerate(texts(column)):
        parts = text.translate(LOWER).split()
        if parts:
            out[i] = xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    return [out.view(np.int64)]


def runs(text: bytes) -> np.ndarray:
    """A 64-bit hash of each run of ``WORDS`` words, of a shorter text as a whole; repeats included."""
    parts = text.translate(LOWER).split()
    one = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    size = min(WORDS, len(parts))
    run = np.full(len(parts) - size + 1, size, np.uint64)
    for i in range(size):
        run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - size + 1 + i])
    return run


def _prints(column: pa.Array) -> list:
    """SimHash fingerprints over each text's different runs, ``PRINT_WORDS`` words of 64 bits; texts must have words."""
    out = []
    for part in blocks(iter([pa.RecordBatch.from_arrays([column], ["t"])]), 0, 1 << 19):
        hashes = [np.unique(runs(text)) for text in texts(part.column(0))]
        all_ = np.concatenate(hashes)
        wide = np.stack([mixed(all_ ^ salt) for salt in SALT], axis=1)
        out += [x.tobytes() for x in majority(wide, np.array([len(run) for run in hashes]))]
    return [pa.array(out, pa.binary())]


def bands(rows: list[bytes]) -> np.ndarray:
    """Bucket numbers, a row of ``BANDS`` for each text; texts must have words."""
    hashes = [runs(text) for text in rows]
    counts = [len(run) for run in hashes]
    all_, starts = np.concatenate(hashes), np.cumsum([0, *counts[:-1]])
    out = np.zeros((len(rows), BANDS), np.uint64)
    for band in range(BANDS):
        name = np.full(len(rows), STEP[band], np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            name = mixed(name + np.minimum.reduceat((all_ ^ FLIP[k]) * TIMES[k], starts))
        out[:, band] = name
    return out


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``band, fp, low``: a bucket's first text in the block (``low`` is ``fp``), and what the block itself ties to one."""
    for block in blocks(batches, 1, BLOCK_BYTES // 4):
        band = bands(texts(block.column(1))).reshape(-1).view(np.int64)
        fp = np.repeat(np.asarray(block.column(0)), BANDS)
        order = np.lexsort((fp, band))
        band, fp = band[order], fp[order]
        first = np.concatenate(([True], band[1:] != band[:-1]))
        low = fp[np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))]
        tied = np.unique(np.stack([fp[~first], low[~first]], axis=1), axis=0)
        columns = (np.concatenate((band[first], tied[:, 0])), np.concatenate((fp[first], tied[:, 0])), np.concatenate((low[first], tied[:, 1])))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["band", "fp", "low"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket and text: each text beside the first one of its bucket."""
    last: tuple | None = None
    for batch in batches:
        band, fp, low = (np.asarray(batch.column(i)) for i in range(3))
        open_ = low == fp
        u, v = [fp[~open_]], [low[~open_]]
        band, fp = band[open_], fp[open_]
        if len(band):
            new = np.concatenate(([last is None or band[0] != last[0]], band[1:] != band[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
            lead = np.where(at < 0, last[1] if last else 0, fp[np.maximum(at, 0)])
            last = band[-1], lead[-1]
            u.append(fp[~new])
            v.append(lead[~new])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


class _Block:
    """Texts that others are compared with; what is linked here is one component from then on."""

    def __init__(self, block: tuple):
        self.key = block
        self.fps: list[int] = []
        self.texts: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.tops: dict[int, int] = {}
        self.parts: list[int] = []
        self.index: tuple | None = None

    def add(self, fp: int, part: int, text: bytes) -> None:
        self.fps.append(fp)
        self.parts.append(part)
        self.texts.append(text)
        self.sets.append(np.unique(runs(text)))

    def top(self, part: int) -> int:
        while (up := self.tops.get(part, part)) != part:
            self.tops[part] = self.tops.get(up, up)
            part = up
        return part

    def links(self, fp: int, part: int, text: bytes, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between a text and this block's that join components, by the runs both have."""
        if self.index is None:
            sizes = np.array([len(x) for x in self.sets])
            names = np.concatenate(self.sets)
            order = np.argsort(names, kind="stable")
            self.index = sizes, names[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        sizes, names, owner = self.index
        low = np.searchsorted(names, own, "left")
        many = np.searchsorted(names, own, "right") - low
        both = np.bincount(owner[np.repeat(low, many) + runs_expanded(many)], minlength=len(sizes))
        mine: set[bytes] | None = None
        for i in np.flatnonzero(SIMILARITY[1] * both >= SIMILARITY[0] * (sizes + len(own) - both)).tolist():
            a, b = self.top(part), self.top(self.parts[i])
            if a == b:
                continue
            mine = shingles(text) if mine is None else mine
            if similar(mine, shingles(self.texts[i])):
                self.tops[max(a, b)] = min(a, b)
                yield fp, self.fps[i]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``root, block, chunk, guest, fp, part, text``, sorted: verified links of guests with their block's texts.

    A block without guests is compared with itself.
    """
    held: _Block | None = None
    met = False

    def itself(block: _Block | None, met: bool) -> list[tuple[int, int]]:
        if block is None or met:
            return []
        return [x for row in zip(block.fps, block.parts, block.texts, block.sets, strict=True) for x in block.links(*row)]

    for batch in batches:
        found: list[tuple[int, int]] = []
        numbers = zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
        for (root, block, chunk, guest, fp, part), text in zip(numbers, texts(batch.column(6)), strict=True):
            if held is None or held.key != (root, block, chunk):
                found += itself(held, met)
                held, met = _Block((root, block, chunk)), False
            if not guest:
                held.add(fp, part, text)
            else:
                met = True
                if held.fps:
                    found += held.links(fp, part, text, np.unique(runs(text)))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])
    rest = itself(held, met)
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rest], pa.int64()) for i in (0, 1)], names=["u", "v"])


PLACE = ("root", "block", "chunk", "guest", "fp")


def _links(rows: DataFrame) -> DataFrame:
    placed = rows.select(*PLACE, "part", "text").repartition("root", "block", "chunk").sortWithinPartitions(*PLACE)
    return written(placed.mapInArrow(_compared, "u long, v long"), "similar-links")


def _count(rows: str, size: str, most_rows: int, most_bytes: int) -> F.Column:
    """Into how many parts of the given size rows go."""
    return F.greatest(F.ceil(F.col(rows) / most_rows), F.ceil(F.col(size) / most_bytes)).cast("int")


def _draw_of(count: str, seed: int) -> F.Column:
    return F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(count)).cast("int")


def _each(count: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def _meeting(members: DataFrame, hosts: DataFrame) -> DataFrame:
    """Every text of ``members`` before every block of its group's ``hosts`` (``block``, of ``blocks``), chunk by chunk."""
    rows = members.withColumn("chunk", _draw_of("chunks", 2)).withColumn("block", _each("blocks")).withColumn("guest", F.lit(1))
    host = hosts.withColumn("chunk", _each("chunks")).withColumn("guest", F.lit(0))
    return rows.select(*PLACE, "part", "text").unionByName(host.select(*PLACE, "part", "text"))


def tree_links(worded: DataFrame) -> DataFrame:
    """Star edges ``u, v`` between texts of ``worded`` (``fp``, unique, and ``text``, with words) whose fingerprints trees link."""
    prints = with_arrow_columns(worded, "text", ["fp"], [StructField("bits", BinaryType(), False)], _prints)
    return wide_links(written(prints, "similar-prints"), PRINT_WORDS, RADIUS)


def bucket_links(worded: DataFrame) -> DataFrame:
    """Star edges ``u, v`` between texts that share a min-hash bucket."""
    made = worded.mapInArrow(_bucket_rows, "band long, fp long, low long")
    # A tie that a block made goes anywhere; a bucket's other rows, one for each block of texts at most, meet.
    made = made.repartition(F.when(F.col("low") != F.col("fp"), F.xxhash64("fp")).otherwise(F.col("band"))).sortWithinPartitions("band", "fp")
    return made.mapInArrow(_stars, "u long, v long")


def _rooted(edges: DataFrame, root: str) -> DataFrame:
    """Every node of the edges beside the first it reaches, which is there too."""
    found = connected(edges).withColumnRenamed("root", root)
    return found.select("node", root).union(found.select(F.col(root).alias("node"), root).distinct())


def links(distinct: DataFrame, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Verified edges ``u, v`` between the texts of ``distinct`` (``fp``, unique, and ``text``), enough to connect all near copies."""
    worded = distinct.where("fp <> 0")
    near = written(tree_links(worded), "similar-trees")
    node = _rooted(near.union(bucket_links(worded)), "loose")
    # Both sides are exchanged at every size.
    members = distinct.join(node.hint("merge"), distinct.fp == node.node).select("loose", "fp", "text", F.octet_length("text").alias("size"))
    members = written(members, "similar-groups")
    found = _tree_groups(members, _rooted(near, "root"), group_rows, group_bytes)
    # What is outside the largest component of its loose group meets all of the group.
    tops = connected(found).withColumnRenamed("root", "top")
    parts = members.join(tops, members.fp == tops.node, "left").select(F.col("loose").alias("root"), "fp", F.coalesce("top", "fp").alias("part"), "size", "text")
    each = parts.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    main = each.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max_by("n", F.struct("n", "part")).alias("main_n"),
                                    F.max_by("b", F.struct("n", "part")).alias("main_b"), F.sum("n").alias("all_n"), F.sum("b").alias("all_b"))
    main = main.withColumn("out_n", F.col("all_n") - F.col("main_n")).withColumn("out_b", F.col("all_b") - F.col("main_b")).where("out_n > 0")
    main = written(main.select("root", "main", _count("out_n", "out_b", group_rows, group_bytes).alias("blocks"),
                               _count("all_n", "all_b", CHUNKS * group_rows, CHUNKS * group_bytes).alias("chunks")), "similar-main")
    parts = parts.join(main, "root")
    rest = parts.where(F.col("part") != F.col("main")).withColumn("block", _draw_of("blocks", 3))
    return found.union(_links(_meeting(parts, rest)))


def _tree_groups(members: DataFrame, node: DataFrame, group_rows: int, group_bytes: int) -> DataFrame:
    """Verified edges within what tree links hold together (``node``, ``root``); of larger groups those with one block."""
    wide = members.join(node, members.fp == node.node).select("root", "fp", F.col("fp").alias("part"), "text", "size")
    sizes = wide.groupBy("root").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    sizes = sizes.withColumn("parts", _count("rows", "bytes", group_rows, group_bytes)).withColumn(
        "chunks", _count("rows", "bytes", CHUNKS * group_rows, CHUNKS * group_bytes))
    large = written(sizes.where("parts > 1"), "similar-sizes")
    small = wide.join(large, "root", "left_anti").select("*", *[F.lit(0).alias(c) for c in ("block", "chunk", "guest")])
    wide = wide.join(large, "root").withColumn("blocks", F.lit(1))
    first = wide.where(_draw_of("parts", 1) == 0).withColumn("block", F.lit(0))
    return _links(small.select(*PLACE, "part", "text").unionByName(_meeting(wide, first)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` without near copies: of each group of linked texts the row with the smallest id stays.

    Letters' case and spacing do not count; null and wordless texts are one
    group.  Rows that repeat the kept id are settled by the text, then by the
    other columns.  A group that has no ids keeps the row with the smallest
    text.  All columns stay as they are, whatever their names; an empty table
    gives an empty one.  Very long texts are compared whole, however large a
    block gets by one of them.  ``group_rows`` says how many texts a task holds
    at a time and changes no result.
    """
    prints = written(named(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), ["doc_id"], "text", "fp"), "similar")
    alone = named(docs.select(docs[text].cast("string").alias("text")), ["text"], "text", "fp")
    distinct = written(alone.groupBy("fp").agg(F.min("text").alias("text")), "similar-distinct")
    roots = connected(links(distinct, group_rows))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.join(lowest, "root").select("fp", "root", "component_id")
    return kept_of_groups(docs, doc_id, text, prints, known, lambda rows, column: named(rows, rows.columns, text, column))


def named(docs: DataFrame, keep: list[str], text: str, column: str) -> DataFrame:
    """Columns ``keep`` beside the name of the text's words as ``column``."""
    return with_arrow_columns(docs, text, keep, [StructField(column, LongType(), False)], _names)
