"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from llm import simhash
from llm.components import connected


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=2):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", low.get(top(i))) for i, (doc, _) in enumerate(rows)), key=str)


def test_edges_and_documents(edge, sample):
    for docs in (edge, sample):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == brute_groups(rows)


@pytest.mark.parametrize("tree_size", [3, 40, 4096])
def test_links_lose_no_connection(spark, tree_size):
    rng = random.Random(tree_size)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:60]:  # near ones, in chains; and many that agree in a whole field
        prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)), p ^ (1 << rng.randrange(64))}
    base = rng.getrandbits(64)
    prints |= {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    got = {r.node: r.root for r in connected(simhash.links(frame, 2, tree_size)).collect()}
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if bin(p ^ q).count("1") <= 2:
                root[top(p)] = top(q)
    want = {}
    for p in prints:
        want.setdefault(top(p), set()).add(int(np.uint64(p).view(np.int64)))
    found = {}
    for p in prints:
        s = int(np.uint64(p).view(np.int64))
        found.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


def test_one_row_of_each_group_stays(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = simhash.keep_one(edge)
    assert got.schema.names == edge.schema.names
    groups = brute_groups(rows)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    named = {c for _, _, c in groups if c is not None}
    assert sorted(i for i, _ in kept if i is not None) == sorted(named)
    assert len(kept) == len(named) + len({p for _, p, c in groups if c is None})
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_long_chain_settles(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v")
    got = connected(edges).collect()
    assert len(got) == 300 and {r.root for r in got} == {0}


def test_fingerprints_of_many_steps(monkeypatch):
    rows = [" ".join(f"w{i * j % 71}" for i in range(n)).encode() for j, n in enumerate([0, 1, 40, 3, 200, 0, 17], 1)]
    want = [brute_print(t.decode()) for t in rows]
    for step in (1, 7, 64):
        monkeypatch.setattr(simhash, "STEP", step)
        assert simhash._fingerprints(rows, 3).tolist() == want


@pytest.mark.parametrize("tree_size", [5, 1024])
def test_wide_links_are_those_of_trees(spark, tree_size):
    """Large trees give every connection that a common field allows; small ones only true links, equal fingerprints too."""
    rng = random.Random(5)
    prints = [rng.getrandbits(256) for _ in range(150)]
    for p in prints[:60]:
        prints += [p ^ sum(1 << b for b in rng.sample(range(256), n)) for n in (3, 30, 60, 70)]
    prints += prints[:20]
    frame = spark.createDataFrame([(i, p.to_bytes(32, "little")) for i, p in enumerate(prints)], "fp long, bits binary")
    got = {frozenset((r.u, r.v)) for r in simhash.wide_links(frame, 4, 64, tree_size).collect()}
    fields = [[p >> at & 0xFFFF for at in range(0, 256, 16)] for p in prints]
    linked = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 64 and any(map(int.__eq__, fields[i], fields[j]))
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if linked(i, j):
                root[top(i)] = top(j)
    assert all(top(i) == top(j) for i, j in map(tuple, got))
    if tree_size == 1024:
        want = [top(i) for i in range(len(prints))]
        root[:] = range(len(prints))
        for i, j in map(tuple, got):
            root[top(i)] = top(j)
        assert [len({want[j] for j in range(len(prints)) if top(j) == top(i)}) for i in range(len(prints))] == [1] * len(prints)
        assert len({top(i) for i in range(len(prints))}) == len(set(want))
    else:
        assert got
