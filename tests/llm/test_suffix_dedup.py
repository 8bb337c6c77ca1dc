"""Suffix-array dedup against a dictionary of all strings."""

import hashlib

import numpy as np
import pytest

from llm import suffix_dedup

NULL = -(1 << 63)


def brute(rows, length=50):
    first = {}
    data = [(NULL if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((None if i == NULL else i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows", [suffix_dedup.HOT_ROWS, 2])
def test_edges_against_brute_force(edge, hot_rows):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(edge, hot_rows=hot_rows).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize(("length", "hot_rows"), [(50, 100_000), (50, 3), (20, 100_000)])
def test_documents_against_brute_force(sample, length, hot_rows):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(sample, length=length, hot_rows=hot_rows).collect()), key=str)
    want = brute(rows, length)
    assert got == want and sum(r[2] for r in want) > 0


def test_cut_keeps_rows_and_columns(edge):
    got = suffix_dedup.cut_repeats(edge)
    assert got.schema.names == edge.schema.names and got.count() == edge.count()
    assert got.where("text is null").count() == edge.where("text is null").count()


def test_empty_table(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_seed_hash_depends_on_its_bytes_alone():
    data = np.frombuffer(b"xxabcdefghijklmnopqrstuvwxabcdefghijklmnopqrstuvw", np.uint8)
    for seed in (1, 5, 8, 12, 16, 21):
        found = suffix_dedup.seed_hashes(data, seed)
        assert found[2] == found[26] and len(set(found.tolist())) == len({data[i : i + seed].tobytes() for i in range(len(found))})
