"""Near copies of the pipeline's stage against exact similarity of all pairs."""

import random

import corpus_pipeline
from llm import similar

SF = "/root/testdata/sf0.001"


def brute_groups(rows):
    sets = [similar.shingles((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i] | sets[j])):
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def kept_ids(rows):
    low = {}
    for (doc, _), group in zip(rows, brute_groups(rows), strict=True):
        if doc is not None:
            low[group] = min(low.get(group, doc), doc)
    return sorted(low.values())


def planted():
    """Texts with copies of falling similarity, a large group of near copies and texts that share much but not enough."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(60):
        base = words(rng.choice([40, 90, 250, 900]))
        out.append(base)
        for changes in (1, 2, 4, len(base) // 45, len(base) // 50, len(base) // 30):
            copy = list(base)
            for at in rng.sample(range(len(base)), changes):
                copy[at] = f"x{rng.randrange(10**6)}"
            out.append(copy)
    base = words(200)
    for _ in range(250):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3, 5])):
            copy[at] = f"y{rng.randrange(10**6)}"
        out.append(copy)
    rng.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


def test_planted_near_copies_are_all_found(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == kept_ids(rows)


def test_large_groups_are_compared_in_blocks(spark):
    """Near copies, and texts of one template of which only some are near enough, in groups of many blocks."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(160)]
    rows = planted()
    for i in range(160):
        copy = list(base)
        for at in rng.sample(range(160), rng.choice([1, 3, 4, 5, 7])):
            copy[at] = f"z{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for group_rows in (2, 16):
        got = similar.keep_one(docs, group_rows=group_rows)
        assert sorted(r.doc_id for r in got.collect()) == kept_ids(rows)


def test_edges_and_documents(edge, sample, nothing):
    for docs in (edge, sample):
        got = similar.keep_one(docs)
        assert got.schema.names == docs.schema.names
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        kept = [r.doc_id for r in got.collect()]
        assert sorted(i for i in kept if i is not None) == sorted(set(kept_ids(rows)))
    assert similar.keep_one(nothing).count() == 0


def test_same_words_make_a_link_at_exactly_four_fifths():
    whole = {bytes([i]) for i in range(9)}
    assert similar.similar(whole, whole) and similar.similar({*whole, b"x"} - {b"\x00"}, whole) and not similar.similar({*whole, b"x", b"y"} - {b"\x00"}, whole)


def test_simhash_trees_give_most_links(spark, monkeypatch):
    """Without rows of min-hash buckets, which look for the links that trees miss, most near copies are still found and nothing else."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def no_rows(batches):
        for batch in batches:
            yield batch.select([0, 0, 0]).slice(0, 0).rename_columns(["band", "fp", "low"])

    monkeypatch.setattr(similar, "_bucket_rows", no_rows)
    got = {r.doc_id for r in similar.keep_one(docs).collect()}
    want = set(kept_ids(rows))
    assert len(got - want) <= 0.1 * (len(rows) - len(want))
    assert got >= want
