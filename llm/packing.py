"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours.

Documents become token ids.  Whole windows of a long document are sequences of
their own; what is left of each document, less than a window, is packed.  Left
pieces are dealt into shards of bounded size, alike ones together, and each
shard holds an inverted BM25 index of its pieces' words.  The longest unused
piece is the next seed: its unused neighbours fill its window in the order of
their scores, the best that no longer fits is cut, and its rest goes on as an
unused piece.  So only a shard's last window has padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from llm.common import blocks, mixed, runs_expanded, shard_of, written

WINDOW = 1024
SHARD_ROWS = 2000
"""Documents of one shard, about; frequent lead words are dealt over several shards."""
SEEN = 500_000
"""Rows that a task remembers to tell repeated ones."""
K1, B = 1.2, 0.75
END = 0


# Fixed value: the public pattern by which byte-level files split text before their merges.
PATTERN = public_tokenizers.PATTERN


def _byte_signs() -> dict[str, int]:
    """The printable signs that byte-level vocabularies write bytes with: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit bytes.

    Where a byte-level file's merges are in the order of its ids, ``tiktoken``
    applies them to the text, which gives the same ids in a fraction of the
    time.  Texts that hold a special token, and those of any other file, are
    encoded by ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told.get("added_tokens") or []]
        split = told.get("pre_tokenizer") or {}
        plain = told.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.fast = self._ranked(told["model"]) if plain else None

    @staticmethod
    def _ranked(model: dict):
        """A rank encoder of the same merges, or None where the order of ids isn't that of the merges."""
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return None
        vocabulary = model["vocab"]
        merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        signs = _byte_signs()
        single = {signs[t]: i for t, i in vocabulary.items() if len(t) == 1 and t in signs}
        if len(single) != 256 or None in merged or merged != sorted(set(merged)) or max(single.values()) > merged[0]:
            return None
        import tiktoken

        ranks = {bytes(map(signs.__getitem__, t)): i for t, i in vocabulary.items() if all(c in signs for c in t)}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return self._encode(texts)
        whole = [i for i, text in enumerate(texts) if any(x in text for x in self.special)]
        out = [array("I", self.fast(text)).tobytes() for text in texts]
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def word_starts(path: str) -> np.ndarray:
    """For each token id, whether it begins a word: its text begins with white space."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size()
    starts = np.zeros(size, bool)
    for token, i in tokenizer.get_vocab().items():
        starts[i] = bool(re.match("[ĠĊĉ▁]", token))  # byte-level signs of space, line and tab; piece sign of space
    return starts


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, doc_tokens, whole`` (checksums of whole windows), ``rest`` (ids), ``lead``, ``copy``.

    ``lead`` is the smallest hash of the rest's neighbouring ids: alike rests often share it.
    ``copy`` parts equal rows: a task's first one of its kind has its thousand of
    partitions' number, each further one a number of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        partition, repeats = TaskContext.get().partitionId(), 0
        seen: set[int] = set()
        for block in blocks(batches, 1):
            texts = [t or "" for t in block.column(1).to_pylist()]
            rows = []
            if len(seen) > SEEN:
                seen.clear()
            for who, ids in zip(block.column(0).to_pylist(), encoder.encode(texts), strict=True):
                kind = hash((str(who), ids))
                copy = partition // 1000
                if kind in seen:
                    repeats += 1
                    copy = (partition + 1) << 32 | repeats
                seen.add(kind)
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                to = n // window * window
                whole = [zlib.crc32(ids[4 * a : 4 * (a + window)]) for a in range(0, to, window)]
                rest = np.frombuffer(ids, "<u4")[to:].astype(np.uint64)
                pairs = mixed(rest[:-1] << np.uint64(32) | rest[1:])
                rows.append((n, whole, ids[4 * to :], int(pairs.min() >> np.uint64(1)) if len(pairs) else 0, copy))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), *columns], names=["doc_id", "doc_tokens", "whole", "rest", "lead", "copy"])

    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = StructType([StructField("doc_id", source.schema["doc_id"].dataType)]).add("doc_tokens", "long").add("whole", ArrayType(LongType())).add("rest", "binary").add("lead", "long").add("copy", "long")
    return source.mapInArrow(run, schema)


class Index:
    """Inverted BM25 index of a shard's pieces; terms are words, named by a hash of their ids."""

    def __init__(self, rests: list[np.ndarray], starts: np.ndarray):
        size = np.array([len(r) for r in rests], np.int64)
        ids = np.concatenate(rests) if rests else np.zeros(0, np.int64)
        self.count = len(rests)
        begins = starts[np.minimum(ids, len(starts) - 1)]
        first = (np.cumsum(size) - size)[size > 0]
        begins[first] = True
        at = np.flatnonzero(begins)
        within = runs_expanded(np.diff(np.append(at, len(ids)))).astype(np.uint64)
        name = np.add.reduceat(mixed(ids.astype(np.uint64) + (within << np.uint64(32))), at) if len(at) else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(rests)), size)[at]
        _, term = np.unique(name, return_inverse=True)
        key, tf = np.unique(row * (term.max() + 1 if len(term) else 1) + term, return_counts=True)
        terms = int(term.max()) + 1 if len(term) else 1
        self.row, self.term = key // terms, key % terms
        df = np.bincount(self.term, minlength=terms)
        idf = np.log1p((self.count - df + 0.5) / (df + 0.5))
        words = np.bincount(row, minlength=max(1, self.count))
        norm = K1 * (1 - B + B * words / max(words.mean(), 1e-9))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.row])
        self.own = np.searchsorted(self.row, np.arange(self.count + 1))
        order = np.argsort(self.term, kind="stable")
        self.posted, self.weight = self.row[order], weight[order]
        self.begin = np.concatenate(([0], np.cumsum(df)))

    def scores(self, row: int) -> np.ndarray:
        """BM25 of every piece for the words of one."""
        terms = self.term[self.own[row] : self.own[row + 1]]
        many = self.begin[terms + 1] - self.begin[terms]
        at = np.repeat(self.begin[terms], many) + runs_expanded(many)
        return np.bincount(self.posted[at], self.weight[at], minlength=self.count)


def fill(rests: list[np.ndarray], starts: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of ``(piece, from, to)`` cuts; every id of every piece lies in exactly one."""
    index = Index(rests, starts)
    size = np.array([len(r) for r in rests], np.int64)
    used = np.zeros(len(rests), np.int64)
    left = size.copy()
    by_length = np.argsort(-size, kind="stable")
    windows, next_seed = [], 0
    waiting: list[int] = []  # pieces that were cut: their rests come first
    while True:
        if waiting:
            seed = waiting.pop()
        else:
            while next_seed < len(by_length) and not left[by_length[next_seed]]:
                next_seed += 1
            if next_seed == len(by_length):
                return windows
            seed = int(by_length[next_seed])
        if not left[seed]:
            continue
        cuts = [(seed, int(used[seed]), int(size[seed]))]
        room = window - int(left[seed])
        left[seed], used[seed] = 0, size[seed]
        if room:
            order = np.argsort(-index.scores(seed), kind="stable")
            order = order[left[order] > 0]
            while room and len(order):
                fits = left[order] <= room
                pick = int(np.argmax(fits)) if fits.any() else 0
                piece = int(order[pick])
                take = min(room, int(left[piece]))
                cuts.append((piece, int(used[piece]), int(used[piece]) + take))
                used[piece] += take
                left[piece] -= take
                room -= take
                if left[piece]:
                    waiting.append(piece)
                order = order[np.arange(len(order)) != pick]
        windows.append(cuts)


PIECES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_rows: int = SHARD_ROWS, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null text counts as empty (its end id alone); rows that repeat an id are
    packed each for itself, equal rows in many shards; an empty table gives no
    piece.  A very long text's whole windows are sequences of their own.  Ties
    of scores go to the piece that comes first by id and length.  Other columns of
    ``docs`` are ignored.  ``path`` names a tokenizer file that every executor has.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    starts = np.packbits(word_starts(path))
    ids = written(tokenized(docs, path, window, doc_id, text), "packing-ids")
    shards = max(1, -(-ids.count() // shard_rows))
    bucket = shard_of("lead") % F.lit(shards)
    # One row per shard: the shards that a bucket with many rows needs, and how many came before it.
    sizes = ids.groupBy(bucket.alias("bucket")).agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    placed = sizes.selectExpr("bucket", "parts", "sum(parts) over (order by bucket rows between unbounded preceding and current row) - parts as before")
    # Wide rows are split by adaptive execution where a bucket is frequent; the next exchange deals them over its shards.
    dealt = ids.withColumn("bucket", bucket).join(placed, "bucket").withColumn("shard", F.col("before") + shard_of("doc_id", "doc_tokens", "rest", "copy") % F.col("parts"))

    def work(part: pa.Table) -> pa.Table:
        flags = np.unpackbits(starts).astype(bool)
        part = part.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("lead", "ascending")])
        tokens, lead = (part.column(c).to_pylist() for c in ("doc_tokens", "shard"))
        wholes, held = part.column("whole").to_pylist(), part.column("rest").to_pylist()
        rests = [np.frombuffer(x, "<u4").astype(np.int64) for x in held]
        rows: list[tuple] = []
        sequence = lead[0] << 32
        for i, sums in enumerate(wholes):
            for k, crc in enumerate(sums):
                rows.append((i, k * window, window, crc, tokens[i], sequence, 0))
                sequence += 1
        for cuts in fill(rests, flags, window):
            offset = 0
            for i, a, b in cuts:
                rows.append((i, len(wholes[i]) * window + a, b - a, zlib.crc32(held[i][4 * a : 4 * b]), tokens[i], sequence, offset))
                offset += b - a
            sequence += 1
        who = pa.array([r[0] for r in rows], pa.int64())
        return pa.Table.from_arrays([part.column("doc_id").take(who)] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 7)], names=["doc_id", *PIECES])

    schema = StructType([StructField("doc_id", ids.schema["doc_id"].dataType)] + [StructField(c, LongType()) for c in PIECES])
    return dealt.select("shard", "doc_id", "doc_tokens", "whole", "rest", "lead").groupBy("shard").applyInArrow(work, schema)


def piece_ids(docs: DataFrame, pieces: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces with their token ids, from the same documents (whose ids must be unique and not null)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    lists = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).join(lists, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for block in blocks(batches, 1):
            made = encoder.encode([t or "" for t in block.column(1).to_pylist()])
            out = [(d, c["sequence_id"], c["offset"], np.frombuffer(ids + END.to_bytes(4, "little"), "<u4")[c["start"] : c["start"] + c["length"]].tolist())
                   for d, ids, cuts in zip(block.column(0).to_pylist(), made, block.column(2).to_pylist(), strict=True) for c in cuts]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (block.column(0).type, pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)],
                    names=["doc_id", "sequence_id", "offset", "ids"])

    schema = StructType([source.schema["doc_id"]]).add("sequence_id", "long").add("offset", "long").add("ids", ArrayType(LongType()))
    return source.mapInArrow(run, schema)
