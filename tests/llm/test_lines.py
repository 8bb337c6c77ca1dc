"""Dropped lines against plain counts, and the perfect hash on its own."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm import lines
from pyspark.sql import functions as F

BLANK = " \t\n\v\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs=10, min_chars=1):
    held = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")} if len(k) >= min_chars)
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if held[key(x)] < min_docs]
        out.append((doc, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def numbers(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, np.uint64, endpoint=False), rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash_numbers_each_key_once(n):
    a, b = numbers(n)
    made = lines.PerfectHash.build(a, b)
    assert sorted(made.numbers(a, b).tolist()) == list(range(n))
    assert n < 1000 or len(made.bits) * 64 < 4.2 * n


def test_keys_that_share_a_half_are_told_apart():
    a, b = numbers(500)
    a, b = np.concatenate([a, a, a]), np.concatenate([b, b + np.uint64(1), a])
    assert sorted(lines.PerfectHash.build(a, b).numbers(a, b).tolist()) == list(range(1500))
    with pytest.raises(ValueError):
        lines.PerfectHash.build(np.append(a, a[0]), np.append(b, b[0]))


def rows_of_many_shapes():
    rng = random.Random(5)
    common = ["Share this page", "  Subscribe now ", "ÄRGER im Text", "x", "", " ", "\t", "fünf"]
    out = []
    for i in range(400):
        some = [rng.choice(common) if rng.random() < 0.4 else f"own line {rng.randrange(3000)}" for _ in range(rng.randrange(1, 9))]
        out.append((i if i % 7 else None, "\n".join(x.upper() if rng.random() < 0.3 else x + rng.choice(["", " ", "\r", "\f"]) for x in some)))
    nine, ten = [(1000 + i, "nine of it\nand " + str(i)) for i in range(9)], [(2000 + i, "ten of it\nten of it\nonly " + str(i)) for i in range(10)]
    return out + nine + ten + [(5, "alone\n" * 30), (6, None), (6, ""), (7, "\n"), (8, "Share this page\r\n")] * 3


@pytest.mark.parametrize("block_rows", [3, 10_000])
def test_lines_of_many_shapes(spark, monkeypatch, block_rows):
    monkeypatch.setattr(lines, "BLOCK_ROWS", block_rows)
    rows = rows_of_many_shapes()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, lines.measured(docs).collect()), key=str) == brute(rows)


def test_edges_and_documents(edge, sample, nothing):
    for docs in (edge, sample, sample.unionByName(sample), sample.unionByName(sample.where("doc_id % 3 = 0"))):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, lines.measured(docs).collect()), key=str) == brute(rows)
    assert lines.measured(nothing).count() == 0 and lines.line_index(nothing).count() == 0


def test_other_thresholds_columns_and_nulls(spark):
    rows = rows_of_many_shapes()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_LINES", F.lit("mine")).withColumn("block", F.lit(1.5)).withColumn("c0", F.array(F.lit(1)))
    got = lines.drop_frequent_lines(docs, min_docs=3, min_chars=5)
    assert got.columns == ["doc_id", "text", "N_LINES", "block", "c0", "n_lines_", "n_dropped"]
    told = got.collect()
    assert {(r["N_LINES"], r.block, tuple(r.c0)) for r in told} == {("mine", 1.5, (1,))}
    have = sorted(((r.doc_id, r["n_lines_"], r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in told), key=str)
    assert have == brute(rows, 3, 5)
    assert sum(r.text is None for r in told) == sum(t is None for _, t in rows)


def test_index_answers_for_other_documents(spark, sample):
    index = lines.line_index(sample).collect()
    held = Counter(k for r in sample.collect() for k in {key(x) for x in (r.text or "").split("\n")} if k)
    shards = {r.shard: r.asDict() for r in index}
    assert sum(r["keys"] for r in index) == len(held)
    known = list(held)[:400]
    for k, want in [*((k, held[k]) for k in known), *((f"never seen {i}", 0) for i in range(200))]:
        a, b = (np.array([x]) for x in np.frombuffer(lines.xxhash.xxh3_128_digest(k.encode()), "<u8"))
        shard = shards.get(int(a.view(np.int64)[0]) % index[0].shards)
        assert (int(lines.probe(shard, a, b)[0]) if shard else 0) == want
