"""Base measures against regular expressions; verdicts against labels."""

import re
from collections import Counter

from llm import quality

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_measures(spark, edge, sample):
    odd = spark.createDataFrame([(1, "a b c d e f g h " * 3 + "\nx #*\nx #*\n \n x #*"), (2, "é ü|\x0bz\x85q")], "doc_id long, text string")
    for docs in (edge, sample, odd):
        model = quality.train(docs, spark.createDataFrame([], LABELS))
        got = quality.score(docs, model, keep=["text"]).collect()
        assert [tuple(r)[1:7] for r in got] == [brute(r.text) for r in got]
        assert all(r.kept == (not r.base_failed) for r in got)  # no label: nothing is below the threshold


def test_verdicts_follow_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    trained = labels.where("doc_id % 2 = 0")
    told = quality.score(docs, quality.train(docs, trained), keep=["doc_id"]).join(labels, "doc_id").where("doc_id % 2 = 1 and not base_failed").collect()
    good, bad = ([r.kept for r in told if r.quality == q] for q in (1, 0))
    assert sum(good) > 0.99 * len(good) and sum(bad) < 0.15 * len(bad)


def test_long_ids_beside_nulls(spark):
    docs = spark.createDataFrame([(1 << 53, "one two three"), (None, "x"), (5, "four")], "doc_id long, text string").coalesce(1)
    told = quality._counts(docs, quality.np.array([(1 << 53) + 1], "int64")).agg({"even": "sum", "odd": "sum"}).first()
    assert tuple(told) == (0, 0)


def test_stage_keeps_columns(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], LABELS)
    got = quality.keep_good(edge, labels)
    assert got.schema == edge.schema and 0 < got.count() < edge.count()
    assert quality.keep_good(nothing, labels).count() == 0
