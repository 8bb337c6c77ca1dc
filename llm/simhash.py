"""SimHash near-duplicate groups found with BK-trees.

A text's fingerprint has 64 bits, the majority of its shingles' XXH64 hashes.
Distinct fingerprints are linked when they differ in at most ``radius`` bits.
The links are searched in BK-trees: a tree's children are keyed by their
integer Hamming distance to the parent, and a query follows only edges within
the radius of its own distance.

One tree over all fingerprints, or every shard's tree sent to every task,
costs all rows times all shards.  So trees are dealt out instead: fingerprints
within ``radius`` bits agree exactly in one of ``radius + 1`` bit fields, hence
each tree holds the fingerprints that agree in one field and a query visits
only its own ``radius + 1`` trees.  Fields with more than ``TREE_SIZE``
fingerprints are split by the same argument over the bits that are left, so no
link is lost and no tree grows with the corpus.

``wide_links`` searches fingerprints of several words, which tell texts of a
similarity of 0.8 from others; no number of bit fields is lossless at their
radius, so it gives most links and its caller finds the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from llm.common import blocks, fresh, runs_expanded, texts, utf8, with_arrow_columns, written
from llm.components import connected

SEED = 42
TREE_SIZE = 4096
"""Fingerprints of one field value above which the value is split by further fields."""
VISITS = 2_000_000
"""Tree nodes that one vectorised step may look at."""
BITS = 64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
STEP = 1 << 16
"""Hashes whose bits are spelled out at a time."""
FIELD_BYTES = 2
"""A tree of wide fingerprints holds those that agree in one field of so many bytes."""
WIDE_TREE_SIZE = 1024
"""Wide fingerprints of one tree; a field value with more has several, by the next field's bits and then in the order of the bits."""


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one text."""
    return int(_fingerprints([text], words)[0])


def _fingerprints(rows: list[bytes], words: int) -> np.ndarray:
    hashes: list[int] = []
    counts = np.zeros(len(rows), np.int64)
    one = xxhash.xxh64_intdigest
    for i, text in enumerate(rows):
        parts = text.translate(LOWER).split()
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(one(joined, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes += [one(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
        counts[i] = len(parts) - words + 1
    return majority(np.array(hashes, "<u8").reshape(-1, 1), counts)[:, 0]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's fingerprint, zero without hashes: the bits set in over half of its ``counts`` rows of ``hashes`` (of one or more words)."""
    out = np.zeros((len(counts), hashes.shape[1]), np.uint64)
    end = 0
    for i, count in enumerate(counts.tolist()):
        if not count:
            continue
        start, end = end, end + count
        ones = sum(
            np.unpackbits(hashes[at : min(at + STEP, end)].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for at in range(start, end, STEP))
        out[i] = np.packbits(2 * ones > count, bitorder="little").view("<u8")
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the signed long of its text's fingerprint; null and wordless texts have 0."""
    return _beside(docs, [doc_id], text, words, "fp")


def fingerprints_beside(docs: DataFrame, text: str, words: int, column: str) -> DataFrame:
    """All columns of ``docs`` and the fingerprint as ``column``."""
    return _beside(docs, docs.columns, text, words, column)


def _beside(docs: DataFrame, keep: list[str], text: str, words: int, column: str) -> DataFrame:
    def work(column: pa.Array) -> list:
        out = np.zeros(len(column), np.uint64)
        at = 0
        for part in blocks(iter([pa.RecordBatch.from_arrays([column], ["t"])]), 0, 1 << 20):
            rows = texts(part.column(0))
            out[at : at + len(rows)] = _fingerprints(rows, words)
            at += len(rows)
        return [out.view(np.int64)]

    return with_arrow_columns(docs, text, keep, [StructField(column, LongType(), False)], work)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which are numbers or rows of numbers."""
    bits = np.bitwise_count(a ^ b)
    return bits.astype(np.int64) if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over groups of distinct fingerprints, all built and searched together.

    ``group`` numbers are ascending; the first member of a group is its root.
    """

    def __init__(self, values: np.ndarray, group: np.ndarray):
        self.values = values
        self.bits = BITS * (values.shape[1] if values.ndim > 1 else 1)
        n = len(values)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(first, n))
        self.root = np.repeat(first, self.sizes)
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        node = self.root[waiting]
        keys, children = [], []
        while len(waiting):
            key = node * (self.bits + 1) + distance(values[waiting], values[node])
            order = np.argsort(key, kind="stable")
            key, waiting = key[order], waiting[order]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            keys.append(key[head])
            children.append(waiting[head])
            node = np.repeat(waiting[head], np.diff(np.append(np.flatnonzero(head), len(key))))[~head]
            waiting = waiting[~head]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.keys, self.children = key[order], (np.concatenate(children) if children else key)[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions within the radius, in steps of bounded size."""
        cost = np.cumsum(self.sizes[np.searchsorted(np.cumsum(self.sizes), np.arange(len(self.values)), "right")]) if len(self.values) else np.zeros(0)
        at = 0
        while at < len(self.values):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + VISITS, "right")))
            query = np.arange(at, to)
            node = self.root[query]
            while len(query):
                d = distance(self.values[query], self.values[node])
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.keys, node * (self.bits + 1) + np.maximum(1, d - radius), "left")
                high = np.searchsorted(self.keys, node * (self.bits + 1) + np.minimum(self.bits, d + radius), "right")
                many = high - low
                node = self.children[np.repeat(low, many) + runs_expanded(many)]
                query = np.repeat(query, many)
            at = to


def _components(values: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """The position of the first of each fingerprint's component, links followed within groups; links are not held."""
    label = np.arange(len(values))
    for a, b in Forest(values, group).links(radius):
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low < high
            a, b = a[apart], b[apart]
            np.minimum.at(label, high[apart], low[apart])
            while (label[label] < label).any():
                label = label[label]
    return label


def _stars(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint linked to others of its group, beside the first of its component."""
    label = _components(values, group, radius)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _fields(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """Bit ranges [from, to) that cut [low, high) into near-equal parts."""
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _bits(ranges: list[tuple[int, int]]) -> F.Column:
    """The fingerprint's bits in the ranges, the others zero."""
    mask = sum(((1 << (b - a)) - 1) << a for a, b in ranges)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))


def links(found: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """Star edges ``u, v`` that join distinct fingerprints ``fp`` within the radius.

    Not every pair is spelled out: within one tree each linked fingerprint
    points to the first of its component, which keeps all connections and
    stays linear in the rows.
    """
    if radius >= BITS // 2:
        raise ValueError("radius must be below 32")
    fields = _fields(0, BITS, radius + 1)
    keyed = found.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), _bits([r]).alias("held")) for i, r in enumerate(fields)])).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("field", "held").agg(F.count("*").alias("n")).where(F.col("n") > tree_size).select("field", "held", F.lit(True).alias("hot"))
    keyed = keyed.join(sizes, ["field", "held"], "left")
    finer = []
    for i, (low, high) in enumerate(fields):
        rest = [(0, low), (high, BITS)]
        cut = _fields(0, BITS - (high - low), radius + 1)
        for j, (a, b) in enumerate(cut):
            ranges, at = [], 0
            for x, y in rest:  # the part of bits [a, b) of those that are left
                lo, hi = max(a, at), min(b, at + y - x)
                if lo < hi:
                    ranges.append((x + lo - at, x + hi - at))
                at += y - x
            finer.append((i, F.struct(F.lit(j).alias("part"), _bits(ranges).alias("rest"))))
    plain = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("rest")))
    choice = plain
    for i in range(len(fields)):
        choice = F.when(F.col("hot") & (F.col("field") == i), F.array(*[s for k, s in finer if k == i])).otherwise(choice)
    routed = keyed.select("fp", "field", "held", F.explode(choice).alias("s")).select("fp", F.xxhash64("field", "held", "s.part", "s.rest").alias("tree"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def out(tree: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = _stars(fp.view(np.uint64), tree, radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            tree, fp = (np.asarray(batch.column(i)) for i in (1, 0))
            held.append((tree, fp))
            rows += len(tree)
            if rows < 20_000:
                continue
            tree, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(tree, tree[-1], "left"))  # the last tree may go on
            if cut:
                yield from out(tree[:cut], fp[:cut])
            held, rows = [(tree[cut:], fp[cut:])], len(tree) - cut
        if rows:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    # A tree's members come together and in order, so a retried task builds the same tree.
    return routed.repartition("tree").sortWithinPartitions("tree", "fp").mapInArrow(search, "u long, v long")


def wide_links(prints: DataFrame, words: int, radius: int, tree_size: int = WIDE_TREE_SIZE) -> DataFrame:
    """Star edges ``u, v`` that join names ``fp`` whose fingerprints ``bits`` (binary, of 8 * ``words`` bytes) are within the radius.

    A pair is found if it agrees in one of the ``4 * words`` bit fields and its
    tree holds both.  A tree has at most ``tree_size`` members, so a row costs
    no more than that many comparisons a field, however many texts are alike.
    Rows without bits must be left out; equal fingerprints are linked.
    """
    size = 8 * words
    starts = range(0, size, FIELD_BYTES)
    fields = [F.struct(F.lit(i).alias("field"), F.substring("bits", i + 1, FIELD_BYTES).alias("held"),
                       F.substring("bits", (i + FIELD_BYTES) % size + 1, FIELD_BYTES).alias("next")) for i in starts]
    keyed = prints.select("fp", "bits", F.explode(F.array(*fields)).alias("k")).select("fp", "bits", "k.*")
    hot = keyed.groupBy("field", "held").agg(F.count("*").alias("n")).where(F.col("n") > tree_size).select("field", "held", F.lit(True).alias("hot"))
    # Written, so that its size is known and a small one spares the fingerprints an exchange.
    routed = keyed.join(written(hot, "simhash-hot"), ["field", "held"], "left").select(F.xxhash64("field", "held", F.when(F.col("hot"), F.col("next"))).alias("tree"), "bits", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, bits, fp = np.zeros(0, np.int64), np.zeros((0, words), np.uint64), np.zeros(0, np.int64)

        def cut() -> np.ndarray:
            """Tree numbers of the held rows: by key, then in runs of ``tree_size``."""
            first = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
            place = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
            return np.cumsum(place % tree_size == 0)

        def out(group: np.ndarray) -> pa.RecordBatch:
            values, names = bits[: len(group)], fp[: len(group)]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (values[1:] != values[:-1]).any(axis=1)))
            one = np.flatnonzero(new)  # equal fingerprints stand together
            head = one[_components(values[one], group[one], radius)][np.cumsum(new) - 1]
            moved = np.flatnonzero(names != names[head])
            return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[head[moved]])], names=["u", "v"])

        for batch in batches:
            tree = np.concatenate((tree, np.asarray(batch.column(0))))
            bits = np.concatenate((bits, utf8(batch.column(1))[0].view("<u8").reshape(-1, words)))
            fp = np.concatenate((fp, np.asarray(batch.column(2))))
            if len(tree) < 20 * tree_size:
                continue
            group = cut()
            group = group[: np.searchsorted(group, group[-1], "left")]  # the last tree may go on
            yield out(group)
            tree, bits, fp = tree[len(group) :], bits[len(group) :], fp[len(group) :]
        if len(tree):
            yield out(cut())

    # A tree's members come together and in order, so a retried task builds the same tree.
    return routed.repartition("tree").sortWithinPartitions("tree", "bits", "fp").mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2,
                    tree_size: int = TREE_SIZE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest doc_id that links can reach.  Null and
    wordless texts share fingerprint zero.  A null id never is a component's
    id unless it has no other (then null); repeated rows are repeated.  An
    empty table gives an empty result.  Further columns of ``docs`` are
    ignored, whatever their names.
    """
    prints, known = _grouped(docs, doc_id, text, words, radius, tree_size)
    return prints.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def _grouped(docs: DataFrame, doc_id: str, text: str, words: int, radius: int, tree_size: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` of each row; ``fp, root, component_id`` of each fingerprint."""
    prints = written(fingerprints(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), words=words), "simhash")
    found = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = connected(links(found, radius, tree_size))
    placed = found.join(roots, found.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, placed.join(lowest, "root").select("fp", "root", "component_id")


def _one_each(rows: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    """One row per key: the smallest by text, then by all columns that have an order.

    ``min_by`` combines before the shuffle: a row repeated a million times costs one per task.
    """
    ordered = [c for c in columns if c != text and not rows.schema[c].dataType.typeName() in ("map", "variant")]
    one = fresh(rows, "_one")
    picked = rows.groupBy(rows[key].alias(key)).agg(
        F.min_by(F.struct(*[rows[c].alias(f"c{i}") for i, c in enumerate(columns)]), F.struct(*[rows[c].alias(f"o{i}") for i, c in enumerate([text, *ordered])])).alias(one))
    return picked.select(*[F.col(f"{one}.c{i}").alias(c) for i, c in enumerate(columns)])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the smallest id stays.

    Rows that repeat the kept id are settled by the text, then by the other
    columns.  A group that has no ids keeps the row with the smallest text.
    All columns stay as they are.
    """
    prints, known = _grouped(docs, doc_id, text, words, radius, TREE_SIZE)
    return kept_of_groups(docs, doc_id, text, prints, known, lambda rows, column: fingerprints_beside(rows, text, words, column))


def kept_of_groups(docs: DataFrame, doc_id: str, text: str, prints: DataFrame, known: DataFrame, beside: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """One row of ``docs`` per group.

    ``prints`` has ``doc_id, fp`` of each row, ``known`` the ``fp, root,
    component_id`` of each ``fp``; ``beside`` adds the ``fp`` as a column.
    """
    known = written(known, "simhash-groups")
    mine, count = fresh(docs, "_id"), fresh(docs, "_rows")
    stay = prints.where(F.col("doc_id").isNotNull()).join(known, "fp").where(F.col("doc_id") == F.col("component_id"))
    stay = stay.groupBy(F.col("doc_id").alias(mine)).agg(F.count("*").alias(count))
    # The kept ids grow with the documents, so the way is the same at every size: both sides are exchanged.
    kept = docs.join(written(stay, "simhash-stay").hint("merge"), docs[doc_id] == F.col(mine))
    single = kept.where(F.col(count) == 1).select(*[kept[c] for c in docs.columns])
    repeated = _one_each(kept.where(F.col(count) > 1), docs.columns, mine, text)
    nameless = docs.where(docs[doc_id].isNull())
    fp, root = fresh(docs, "_fp"), fresh(docs, "_root")
    nameless = beside(nameless, fp)
    only = known.where(F.col("component_id").isNull()).select(F.col("fp").alias(f"{fp}_"), F.col("root").alias(root))
    nameless = nameless.join(only, F.col(fp) == F.col(f"{fp}_"))
    return single.unionByName(repeated).unionByName(_one_each(nameless, docs.columns, root, text))
