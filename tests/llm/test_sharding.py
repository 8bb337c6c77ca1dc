"""Exact shard sizes, gapless slots, uniform law."""

import zlib

import numpy as np

from llm import sharding


def test_matrix_has_exact_sums():
    sizes = [5, 0, 17, 1000, 3]
    for seed in range(5):
        m = sharding.communication_matrix(sizes, 8, seed)
        assert m.sum(1).tolist() == sizes and max(m.sum(0)) - min(m.sum(0)) <= 1 and (m >= 0).all()


def test_matrix_follows_the_hypergeometric_law():
    draws = np.array([sharding.communication_matrix([4, 4], 2, s)[0, 0] for s in range(3000)])
    want = np.array([1, 16, 36, 16, 1]) / 70
    assert abs(np.bincount(draws, minlength=5) / 3000 - want).max() < 0.03


def test_hypergeometric_of_many_rows():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 9 * 10**9, 10**6
    x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(300)])
    assert abs(x.mean() - n / 4) < 150 and 350 < x.std() < 520
    assert sharding.hypergeometric(rng, 2 * 10**9, 0, 7) == 7 and sharding.hypergeometric(rng, 0, 2 * 10**9, 7) == 0


def test_every_row_has_one_place(edge, sample):
    for docs in (edge, sample.repartition(5)):
        got = sharding.law(docs).collect()
        rows = docs.collect()
        key = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(key(r.doc_id, r.text) for r in rows)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
        sizes = [len(by.get(s, [])) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(r.law == "rows" and r.grown_shard is None for r in got)


def test_slots_over_several_blocks(sample):
    light = sample.select("doc_id", "lang")
    got = sharding.shuffled(light, 3, block_rows=7).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(len([r for r in got if r.shard == s]))]


def test_write_and_empty(spark, sample, nothing, tmp_path):
    assert sharding.law(nothing).count() == 0
    sharding.write_shards(sharding.shuffled(sample.select("doc_id", "text"), 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == sample.count() and back.select("shard").distinct().count() == 4
