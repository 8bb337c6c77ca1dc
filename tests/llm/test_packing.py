"""Packing: every id in one piece, full windows, equal to plain tokenization."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a", "a  b", "a \n b", "x<|endoftext|> y", " ", "\n", "don't we'll  ", "a b c", "\x1c a", "漢字 a", "tab\t x", "end "]


def test_encoder_equals_the_tokenizer(sample):
    texts = [r.text or "" for r in sample.collect()] + ODD
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    assert encoder.fast is not None
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want
    encoder.fast = None
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def held(docs, pieces, window=1024):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    by, sequences = {}, {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert set(by) == set(ids)
    for doc, parts in by.items():
        assert sum(n for _, n in parts) == len(ids[doc]) and sorted(parts) == [(sum(n for _, n in sorted(parts)[:i]), n) for i, (_, n) in enumerate(sorted(parts))]
    padding = 0
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) and n > 0 for i, (o, n) in enumerate(parts))
        padding += window - sum(n for _, n in parts)
        assert sum(n for _, n in parts) <= window
    return padding / (window * len(sequences))


@pytest.mark.parametrize("shard_rows", [2000, 40])
def test_documents(sample, shard_rows):
    assert held(sample, packing.pack(sample, shard_rows=shard_rows).collect()) < (0.01 if shard_rows == 2000 else 0.1)


def test_edges(spark, edge, nothing):
    unique = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert held(unique, packing.pack(unique).collect()) < 0.2
    total = packing.pack(edge).groupBy().sum("length").first()[0]
    tokenizer = Tokenizer.from_file(PATH)
    assert total == sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in edge.collect())
    assert packing.pack(nothing).count() == 0


def test_equal_rows_lie_in_many_shards(spark):
    equal = spark.range(6000).selectExpr("cast(null as long) as doc_id", "'the same words again' as text")
    shards = packing.pack(equal, shard_rows=500).selectExpr("sequence_id >> 32 as shard").groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) >= 6000 and len(shards) >= 10 and max(r["count"] for r in shards) < 800


def test_neighbours_share_words():
    starts = np.zeros(200, bool)
    starts[100:] = True
    alike, other = [100, 101, 102, 103] * 10, [150, 151, 152, 153] * 10
    windows = packing.fill([np.array(x) for x in (alike, other, alike[:30], other[:30])], starts, 70)
    assert sorted(sorted(c[0] for c in w) for w in windows) == [[0, 2], [1, 3]]


def test_piece_ids(sample):
    pieces = packing.pack(sample)
    got = {(r.sequence_id, r.offset): r.ids for r in packing.piece_ids(sample, pieces).collect()}
    for r in pieces.collect():
        assert zlib.crc32(np.array(got[r.sequence_id, r.offset], "<u4").tobytes()) == r.ids_crc32
