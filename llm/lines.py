"""Frequent lines dropped, by probing a sharded minimal perfect hash.

A line's key is a 128-bit hash.  Documents are read in blocks of bounded size
and each block names its distinct keys once, with the number of its documents
that hold them, so a line that a third of all documents share costs a row a
block.  Keys are dealt into shards by their hash; each shard becomes one row of
the index: the bit arrays of a minimal perfect hash over its distinct keys and,
in the order that it gives them, an array of 32-bit fingerprints and one of
document counts in the narrowest type that holds them.  Blocks probe the
arrays shard by shard: no line is joined with another, and what comes back to a
block is the list of its keys that are frequent.

The blocks are settled by a written table, so a task that runs again cuts the
same lines.  Shards hold about ``SHARD_KEYS`` rows at any size of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from llm.common import BLOCK_BYTES, arrow_type, blocks, fresh, mixed, texts, written

BLANK = b" \t\n\v\f\r"
MIN_DOCS, MIN_CHARS = 10, 1
SHARD_KEYS = 250_000
BLOCK_ROWS = 10_000
GAMMA = 2.0
"""Bits of a level for each key that it has to place; 2 gives about 3.7 bits a key in all."""
MAX_LEVELS = 200
ODD = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: level by level, a bit stands for a key that is alone at its place.

    Keys that meet others go on to the next level.  A key's number is the
    count of set bits before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(a + mixed(b + np.uint64(level * int(ODD) & (1 << 64) - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(a):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys must be distinct")
            size = -(-int(GAMMA * len(a)) // 64) * 64
            place = cls._places(a, b, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[place]
            a, b = a[left], b[left]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint64))

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's number; any number or -1 for a key that it was not built from."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            place = self._places(a[left], b[left], level, size) + self.starts[level]
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            held = self.bits[word]
            hit = (held >> bit) & np.uint64(1) == 1
            low = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(low))[hit]
            left = left[~hit]
        return out


def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(b ^ (a * ODD)) >> np.uint64(32)).astype(np.uint32)


def key_of(line: bytes) -> bytes:
    """A line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)


def line_hashes(text: bytes) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """A text's lines, their keys and the keys' 128-bit hashes."""
    lines = text.split(b"\n")
    keys = [key_of(x) for x in lines]
    one = xxhash.xxh3_128_digest
    return lines, keys, [one(k) for k in keys]


def _numbers(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)


def entries_of(block: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct key hashes of a block of texts and how many of its texts hold each."""
    seen: Counter[bytes] = Counter()
    for text in block:
        _, keys, hashes = line_hashes(text)
        seen.update({h for k, h in zip(keys, hashes, strict=True) if long_enough(k, min_chars)})
    return _numbers(list(seen)), np.fromiter(seen.values(), np.int64, len(seen))


def _blocked(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """A table of both: rows of ``docs`` as ``c0, c1, ...`` with their block, and the blocks' entries ``a, b, docs``."""
    n, at_text = len(docs.columns), docs.columns.index(text)
    own = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = StructType([StructField(x, LongType()) for x in ("block", "a", "b", "docs")] + own)
    names, kinds = schema.names, [arrow_type(f) for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for large in blocks(batches, n):
            for at in range(0, large.num_rows, BLOCK_ROWS):
                block = large.slice(at, BLOCK_ROWS)
                ids, none = pa.array([number] * block.num_rows, pa.int64()), pa.nulls(block.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, none, none, none, *block.columns[:n]], names=names)
                keys, counts = entries_of(texts(block.column(n)), min_chars)
                m = len(counts)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * m, pa.int64()), *(pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in (0, 1)), pa.array(counts),
                         *(pa.nulls(m, kind) for kind in kinds)], names=names)
                number += 1

    renamed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs[text].cast("string").alias("_text"))
    return written(renamed.mapInArrow(run, schema), "lines")


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(table.column(x).combine_chunks()).view(np.uint64) for x in ("a", "b"))


INDEX = "shard long, keys long, sizes binary, bits binary, fingerprints binary, width int, counts binary"


def _build(table: pa.Table) -> pa.Table:
    a, b = _keys(table)
    docs = np.asarray(table.column("docs").combine_chunks())
    order = np.lexsort((b, a))
    a, b, docs = a[order], b[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    docs = np.add.reduceat(docs, first)
    a, b = a[first], b[first]
    made = PerfectHash.build(a, b)
    place = made.numbers(a, b)
    width = next(w for w in (1, 2, 4, 8) if int(docs.max()) < 1 << (8 * w))
    prints, counts = np.zeros(len(a), np.uint32), np.zeros(len(a), f"<u{width}")
    prints[place], counts[place] = fingerprint(a, b), docs
    shard = table.column("shard")[0].as_py()
    row = [shard, len(a), made.sizes.tobytes(), made.bits.tobytes(), prints.tobytes(), width, counts.tobytes()]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.table([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=["shard", "keys", "sizes", "bits", "fingerprints", "width", "counts"])


def probe(index: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Document counts of keys by one shard's arrays; 0 for a key that has another fingerprint than the one in its place."""
    made = PerfectHash(np.frombuffer(index["sizes"], np.int64), np.frombuffer(index["bits"], "<u8"))
    place = made.numbers(a, b)
    known = place >= 0
    out = np.zeros(len(a), np.int64)
    at = place[known]
    same = np.frombuffer(index["fingerprints"], np.uint32)[at] == fingerprint(a[known], b[known])
    out[known] = np.where(same, np.frombuffer(index["counts"], f"<u{index['width']}")[at].astype(np.int64), 0)
    return out


def _entries(blocked: DataFrame, shards: int) -> DataFrame:
    return blocked.where(F.col("a").isNotNull()).select(F.pmod("a", F.lit(shards)).cast("long").alias("shard"), "block", "a", "b", "docs")


def _shards(blocked: DataFrame) -> int:
    """About ``SHARD_KEYS`` entries a shard, and enough shards for all tasks."""
    rows = blocked.where(F.col("a").isNotNull()).count()
    return max(4 * int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_KEYS))


def line_index(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The index of all lines' keys as a written table, a row a shard; ``shard`` is a key's first half modulo the number of shards.

    Columns: ``shard``, ``shards``, ``keys`` (distinct keys), the perfect
    hash's level ``sizes`` and ``bits``, ``fingerprints``, and ``counts`` of
    ``width`` bytes each.  An empty table has no shards.
    """
    blocked = _blocked(docs.select(docs[text].alias("text")), "text", min_chars)
    shards = _shards(blocked)
    made = _entries(blocked, shards).groupBy("shard").applyInArrow(_build, INDEX)
    return written(made.withColumn("shards", F.lit(shards).cast("long")), "line-index")


def drop_frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, n_lines: str = "n_lines",
                        n_dropped: str = "n_dropped") -> DataFrame:
    """All rows of ``docs``, their text without lines whose key ``min_docs`` rows or more hold.

    Keys shorter than ``min_chars`` code points stay.  Every copy of a frequent
    line goes, in every document; the other lines stay as they are, joined by
    line breaks.  Each row counts as a document, so repeated rows count each
    time; ids are not looked at and may be null.  A null or empty text is one
    empty line (null stays null).  Texts of any length are taken whole.  The
    columns ``n_lines`` (before) and ``n_dropped`` are added, under a longer
    name where ``docs`` has theirs.  An empty table gives an empty result.
    """
    if not isinstance(docs.schema[text].dataType, StringType):
        raise TypeError(f"column {text} must be a string")
    names = [fresh(docs, n_lines), fresh(docs, n_dropped)]
    blocked = _blocked(docs, text, min_chars)
    shards = _shards(blocked)
    entries = _entries(blocked, shards)
    index = written(entries.groupBy("shard").applyInArrow(_build, INDEX), "line-index")

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=["block", "a", "b"])
        frequent = probe(held.to_pylist()[0], *_keys(asked)) >= min_docs
        return asked.select(["block", "a", "b"]).filter(pa.array(frequent))

    frequent = entries.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(answer, "block long, a long, b long")
    at_text = docs.columns.index(text)
    own = blocked.schema.fields[4:]
    new = [StructField(f"c{len(own) + i}", LongType()) for i in (0, 1)]
    schema = StructType(own + new)

    def clean(rows: pa.Table, gone: pa.Table) -> pa.Table:
        a, b = _keys(gone)
        drop = {bytes(x) for x in np.stack([a, b], axis=1).view("V16").reshape(-1)} if len(a) else set()
        column = rows.column(f"c{at_text}").combine_chunks()
        kept, lines_, dropped = [], [], []
        for value, known in zip(texts(column), column.is_valid().to_pylist(), strict=True):
            lines, _, hashes = line_hashes(value)
            stay = [x for x, h in zip(lines, hashes, strict=True) if h not in drop] if drop else lines
            kept.append(b"\n".join(stay) if known else None)
            lines_.append(len(lines))
            dropped.append(len(lines) - len(stay))
        columns = [rows.column(f.name) for f in own]
        columns[at_text] = pa.array(kept, pa.binary()).cast(pa.string()).cast(column.type)
        return pa.table([*columns, pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    whole = blocked.where(F.col("a").isNull()).select("block", *[f.name for f in own])
    made = whole.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(clean, schema)
    return made.toDF(*docs.columns, *names)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` its lines, how many are dropped, and the digest of what is left."""
    kept = drop_frequent_lines(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle() -> str:
    """DuckDB SQL for ``measured`` over ``documents``: every line is grouped by its key."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM docs),
keyed AS (SELECT r, i, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {MIN_DOCS}),
marked AS (SELECT r, i, line, k IN (SELECT k FROM frequent) AS gone FROM keyed),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t
  FROM marked GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept.t) AS kept_sha256 FROM docs JOIN kept USING (r)
"""
