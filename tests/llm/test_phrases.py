"""Collocations against plain counts, and the trie on its own."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm import phrases
from pyspark.sql import functions as F


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def brute(rows, min_count, max_words=5, top=2000, share=(100, 100)):
    """The contract in whole numbers; a longer candidate of any length may drop a phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    dropped = set()
    for (lang, words), longer in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if share[1] * longer >= share[0] * f[lang, words[i : i + k]]:
                    dropped.add((lang, words[i : i + k]))
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in dropped:
            score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def got(found):
    return sorted(map(tuple, found.collect()))


def corpus(seed=1, texts=300):
    rng = random.Random(seed)
    fixed = ["New York", "new york city hall", "à la carte", "in order to", "Straße\x1fnach Ütrecht", "a a a a a a", "漢 字"]
    out = []
    for i in range(texts):
        words = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ?"]) for w in words)
        out.append((i, rng.choice(["en", "de", None, "und"]), text))
    return out + [(None, None, None), (1, "en", ""), (2, "de", " .,; "), (2, "de", " .,; ")]


def test_words_and_pieces():
    for _, _, text in corpus():
        words, piece = phrases.words_of([text.encode() if text else b""])
        have = [[] for _ in range(int(piece.max()) + 1)] if len(piece) else []
        for w, p in zip(words.to_pylist(), piece, strict=True):
            have[p].append(w.decode())
        assert [x for x in have if x] == [x for x in pieces(text) if x]


@pytest.mark.parametrize("words, burst", [(1, 4), (2, 4), (3, 4), (5, 7), (3, 100_000)])
def test_trie_counts_bursts_and_spills(words, burst):
    rng = np.random.default_rng(words)
    trie, want, have = phrases.HatTrie(words, burst), Counter(), Counter()
    for _ in range(30):
        rows, counts = phrases._counted(rng.integers(1, 9, (200, words)).astype(np.uint64))
        want.update({tuple(r): n for r, n in zip(rows.tolist(), counts.tolist(), strict=True)})
        trie.add(rows, counts)
        assert trie.entries == trie._size(trie.root)
        if trie.entries > 60:
            held = trie.entries
            spilled, totals = trie.spill(held // 2)
            assert trie.entries <= held // 2 and spilled.tolist() == sorted(spilled.tolist()) and len(spilled) == held - trie.entries
            have.update({tuple(r): n for r, n in zip(spilled.tolist(), totals.tolist(), strict=True)})
    assert words == 1 or burst > 1000 or isinstance(trie.root, phrases.Node)
    spilled, totals = trie.spill(0)
    have.update({tuple(r): n for r, n in zip(spilled.tolist(), totals.tolist(), strict=True)})
    assert have == want and trie.entries == 0


def test_runs_of_a_prefix_come_together():
    rng = np.random.default_rng(0)
    rows, counts = phrases._counted(rng.integers(1, 40, (3000, 3)).astype(np.uint64))
    batch = phrases._runs(rows, counts, 16)
    place, have = {}, []
    for prefix, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        table = pa.table([pa.array([prefix] * 2), pa.array([run, run], pa.binary())], names=["prefix", "run"])
        keys = [tuple(np.frombuffer(k, ">u8").tolist()) for k in phrases._merged(3, 0)(table).column("key").to_pylist()]
        assert keys == sorted(keys)
        assert all(place.setdefault(k[:2], prefix) == prefix for k in keys)
        have += keys
    assert sorted(have) == sorted(map(tuple, rows.tolist()))


@pytest.mark.parametrize("min_count, max_words, share", [(5, 5, (100, 100)), (3, 3, (100, 100)), (8, 5, (80, 100)), (2, 7, (100, 100))])
def test_many_shapes(spark, min_count, max_words, share):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    want = brute([(x, t) for _, x, t in rows], min_count, max_words, share=share)
    assert want and got(phrases.collocations(docs, min_count=min_count, max_words=max_words, share=share)) == want


def test_small_tries_streams_and_tops(spark, monkeypatch):
    for name, value in (("ENTRIES", 50), ("STREAM", 7), ("FILTER_BITS", 1 << 10), ("PLACES", 40), ("MOST", 3)):
        monkeypatch.setattr(phrases, name, value)
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    assert got(phrases.collocations(docs, min_count=4, top=6)) == brute([(x, t) for _, x, t in rows], 4, top=6)


def test_words_that_share_an_id_get_another_seed(spark, monkeypatch):
    real = phrases.word_ids
    seeds = []

    def shared(words, lang, seed):
        seeds.append(seed)
        ids = real(words, lang, seed)
        return np.where(ids % np.uint64(5) == 0, np.uint64(5), ids) if seed == 0 else ids

    monkeypatch.setattr(phrases, "word_ids", shared)
    rows = corpus(3, 60)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert got(phrases.collocations(docs, min_count=3)) == brute([(x, t) for _, x, t in rows], 3)


def test_scores_pass_64_bits(spark):
    values = [(7 * 10**11 + 3, 10**13 + 9, 8 * 10**11 + 1, 9 * 10**11 + 7), (100, 10**15, 10**9, 10**9), (10**12, 10**14 + 1, 10**12 + 1, 10**12)]
    rows = spark.createDataFrame(values, "a long, n long, l long, r long")
    a, n, l, r = (F.col(c).cast("decimal(20,0)") for c in ("a", "n", "l", "r"))
    told = rows.select((F.lit(1000).cast("decimal(4,0)") * a * n).alias("t"), (l * r).alias("b")).select(F.expr("t div b").alias("s"))
    assert [x.s for x in told.collect()] == [1000 * a * n // (l * r) for a, n, l, r in values]


def test_edges_documents_and_clashing_names(edge, sample, nothing):
    for docs in (edge, sample):
        docs = docs.withColumns({"key": F.lit("x"), "n": F.lit(1), "score": F.lit(2)})
        rows = [(r.lang, r.text) for r in docs.collect()]
        assert got(phrases.collocations(docs, min_count=10)) == brute(rows, 10)
    assert phrases.collocations(nothing).collect() == []


def test_places_of_pairs_are_packed_in_little_memory(monkeypatch):
    """Every place with its count, from few bytes an occurrence: copies of 64 bits a place took over 3,000 MB of an executor."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from llm import phrases

    rng = np.random.default_rng(1)
    ids = rng.integers(1, 2**62, 1_000_001, np.uint64)
    ids[0] = 0
    batch = pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], names=["ids"])
    monkeypatch.setattr(phrases, "PLACES", 1_500_000)
    monkeypatch.setattr(phrases, "STREAM", 1 << 12)
    size, parts = 1 << 20, 64
    tracemalloc.start()
    told = list(phrases._pair_places(size, parts)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    got = np.zeros(size, np.int64)
    for rows in told:
        for part, run in zip(rows.column("part").to_pylist(), rows.column("run").to_pylist(), strict=True):
            m = int.from_bytes(run[:8], "little")
            raw = pa.decompress(run[8:], 6 * m, "zstd", asbytes=True)
            at = part * (size // parts) + np.cumsum(np.frombuffer(raw, np.uint32, m), dtype=np.int64)
            got[at] += np.frombuffer(raw, np.uint16, m, 4 * m)
    pairs = np.stack([ids[1:-1], ids[2:]], axis=1)
    want = np.bincount((phrases.names(pairs) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    assert (got == want).all()
