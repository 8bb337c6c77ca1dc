"""Merkle fingerprints: edits, equality, likeness, native plan."""

import hashlib

import pytest
from pyspark.sql import functions as F

from llm import fingerprints


def brute(rows):
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in rows), key=lambda r: r[0], reverse=True)
    out = []
    for n, (i, t) in enumerate(order):
        k = len(t) // 3
        edited = t[: len(t) - k] + order[(n + 1) % len(order)][1][:k]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size", [1000, 32 << 20])
def test_documents_against_brute_force(sample, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", size)
    got = fingerprints.compared(sample).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute([(r.doc_id, r.text) for r in sample.collect()])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.98 * len(long)


def test_edges(edge, nothing):
    got = fingerprints.compared(edge).collect()
    assert len(got) == edge.count() and fingerprints.compared(nothing).count() == 0
    plain = fingerprints.fingerprints(edge).collect()
    by = {}
    for r in plain:
        by.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_null_ids_spoil_no_bucket(spark, sample, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 64 << 10)
    rows = sample.selectExpr("case when doc_id % 3 = 0 then null else doc_id end as doc_id", "text")
    got = fingerprints.with_next(rows).collect()
    held = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.h, r.t) for r in rows.selectExpr("doc_id", "coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()),
                  reverse=True)
    want = sorted((a[2], b[2]) for a, b in zip(held, held[1:] + held[:1], strict=True))
    assert sorted((r.t, r.next_t) for r in got) == want
    keyed = rows.selectExpr("doc_id", "coalesce(doc_id, -9223372036854775808) as k", "coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h")
    sizes = fingerprints._bucketed(keyed)[0].groupBy("bucket").agg(F.sum(F.octet_length("t")).alias("n"), F.max(F.octet_length("t")).alias("most")).collect()
    assert len(sizes) > 3 and all(r.n <= 2 * (64 << 10) + r.most for r in sizes)


def test_one_document_is_its_own_next(spark):
    got = fingerprints.compared(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert got.n_chars == 6 and got.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and got.near_next == 1.0


def test_branches_locate_an_edit(spark):
    lines = [f"paragraph number {i} tells about {i * i} things." for i in range(20)]
    changed = list(lines)
    changed[7] = "paragraph number 7 tells something else now."
    rows = fingerprints.fingerprints(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(changed))], "doc_id long, text string"))
    a, b = (rows.where(f"doc_id = {i}").select(F.col("fingerprint").alias(n)) for i, n in ((1, "a"), (2, "b")))
    assert a.crossJoin(b).select(fingerprints.located(F.col("a"), F.col("b"))).first()[0] == [7]


def test_plan_is_native(sample):
    plan = fingerprints.compared(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
