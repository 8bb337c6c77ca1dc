"""Quality rules: base measures and a hashed n-gram log-likelihood ratio.

A text's score is the mean over its byte n-grams of
``log p_target(bucket) - log p_raw(bucket)``: trusted texts against the whole
corpus, both multinomials over hashed n-grams.  Texts at or above the
threshold stay; the threshold is one number, fitted on labelled texts, so
equal texts get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from llm.common import blocks, fresh, runs_expanded, shard_of, texts, utf8, with_arrow_columns

GRAM = 4
BUCKETS_LOG2 = 18
BACKOFF = 1.0
"""Raw-corpus counts added to the target, as n-grams per bucket."""
LABELLED = 20_000
"""Trusted texts, and distrusted ones, that the target and the threshold are fitted on at most: those with the smallest hash of their id."""
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
LOST = 0.002
"""Share of trusted labelled texts that the threshold may reject."""

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

IS_SYMBOL = np.zeros(256, np.int64)
IS_SYMBOL[list(SYMBOLS.encode())] = 1
MIX = np.random.default_rng(7).integers(1, 1 << 62, WINDOW).astype(np.uint64) * np.uint64(2) + np.uint64(1)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Model:
    """``ratio[bucket]`` of fixed size; ``threshold`` on the mean ratio."""

    ratio: np.ndarray
    threshold: float


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams of a block, and each text's number of them."""
    data, ends = utf8(column)
    many = np.maximum(np.diff(ends) - (GRAM - 1), 0)
    if len(data) < GRAM or not many.any():
        return np.zeros(0, np.int64), many * 0
    wide = data.astype(np.uint32)
    packed = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]
    bucket = (packed * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)
    return bucket[np.repeat(ends[:-1], many) + runs_expanded(many)].astype(np.int64), many


def _means(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    bucket, many = _grams(column)
    sums = np.concatenate(([0.0], np.cumsum(ratio[bucket])))
    to = np.cumsum(many)
    return (sums[to] - sums[to - many]) / np.maximum(many, 1)


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """The base measures of one text, in the order of ``BASE``."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    inside = sum(map(len, words))
    flat = np.frombuffer(text, np.uint8)
    chars = inside - int(np.count_nonzero((flat & 0xC0) == 0x80))  # a continuation byte is never white space
    symbols = int(IS_SYMBOL[flat].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > WINDOW:
        each = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        window = sum(each[i : n - WINDOW + 1 + i] * MIX[i] for i in range(WINDOW))
        window ^= window >> np.uint64(32)
        ordered = np.sort(window)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            edge = np.zeros(n + 1, np.int64)
            start = np.flatnonzero(np.isin(window, again))
            np.add.at(edge, start, 1)
            np.add.at(edge, start + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge)[:n]))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _labelled(docs: DataFrame, labels: DataFrame, quality: int, most: int) -> list[int]:
    """Ids of labelled texts, the ``most`` with the smallest hash."""
    rows = labels.where((labels["quality"] == quality) & labels["doc_id"].isNotNull()).select(labels["doc_id"].alias("doc_id")).distinct()
    return sorted(r[0] for r in rows.orderBy(shard_of(F.lit("quality"), "doc_id"), "doc_id").limit(most).collect())


def _counts(docs: DataFrame, trusted: np.ndarray) -> DataFrame:
    """``bucket, raw, even, odd`` over all rows; each task adds up its own first. Trusted texts count by their half."""
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 1 << BUCKETS_LOG2), np.int64)
        for block in blocks(batches, 1):
            bucket, many = _grams(block.column(1))
            sums[0] += np.bincount(bucket, minlength=sums.shape[1])
            ids = np.asarray(pc.fill_null(block.column(0), 0))  # whole numbers stay whole beside nulls
            known = np.asarray(block.column(0).is_valid()) & np.isin(ids, trusted)
            kind = np.repeat(np.where(known, np.searchsorted(trusted, ids) % 2, -1), many)
            for half in (0, 1):
                sums[half + 1] += np.bincount(bucket[kind == half], minlength=sums.shape[1])
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *sums[:, some])], names=["bucket", "raw", "even", "odd"])

    told = source.mapInArrow(run, "bucket long, raw long, even long, odd long").groupBy("bucket")
    return told.agg(*[F.sum(c).alias(c) for c in ("raw", "even", "odd")])


def _threshold(good: np.ndarray, bad: np.ndarray, lost: float) -> float:
    """Halfway between the trusted scores' ``lost`` quantile and nineteen twentieths of the distrusted scores below it."""
    if not len(good) or not len(bad):
        return float("-inf")
    edge = float(np.quantile(good, lost))
    below = bad[bad < edge]
    return (edge + float(np.quantile(below, 0.95))) / 2 if len(below) else edge


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED, lost: float = LOST) -> Model:
    """Raw counts of every document, the target and threshold from at most ``most`` labelled ones of each kind.

    For the threshold each half of the trusted texts is scored against the
    other half, so a text isn't helped by its own n-grams.  Without trusted
    labels the ratio is zero, without either kind nothing is below the
    threshold.
    """
    trusted, distrusted = (np.array(_labelled(docs, labels, q, most), np.int64) for q in (1, 0))
    found = _counts(docs, trusted).toArrow()
    raw, even, odd = (np.zeros(1 << BUCKETS_LOG2) for _ in range(3))
    at = np.asarray(found.column("bucket")).astype(np.int64)
    for sums, name in ((raw, "raw"), (even, "even"), (odd, "odd")):
        sums[at] = np.asarray(found.column(name))
    p_raw = (raw + 1 / len(raw)) / (raw.sum() + 1)

    def against(target: np.ndarray) -> np.ndarray:
        weight = BACKOFF * len(raw)
        told = np.log((target + weight * p_raw) / (target.sum() + weight)) - np.log(p_raw) if target.sum() else np.zeros(len(raw))
        return told.astype(np.float32)

    ratio = against(even + odd)
    halves = [(trusted[::2], against(odd)), (trusted[1::2], against(even)), (distrusted, ratio)]
    scores = [np.zeros(0)] * 3
    if len(trusted) and len(distrusted):
        # 2 * most ids at most
        ids = docs.sparkSession.createDataFrame([(int(i), kind) for kind, (some, _) in enumerate(halves) for i in some], "doc_id long, kind int")
        few = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(ids), "doc_id")
        for kind, (_, own) in enumerate(halves):
            told = score(few.where(F.col("kind") == kind), Model(own, float("-inf")), keep=["doc_id"])
            scores[kind] = np.asarray(told.groupBy("doc_id").agg(F.min("score").alias("score")).toArrow().column("score"))
    return Model(ratio, _threshold(np.concatenate(scores[:2]), scores[2], lost))


FIELDS = [StructField(c, LongType(), False) for c in BASE] + [
    StructField("base_failed", BooleanType(), False), StructField("score", DoubleType(), False), StructField("kept", BooleanType(), False)]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", names: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with the base measures, ``base_failed``, ``score`` and ``kept``.

    A null text counts as empty: no words, base failed, score 0.0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.threshold))  # a fixed number of buckets

    def work(column: pa.Array) -> list:
        known = Model(*shared.value)
        base = np.array([measures(t) for t in texts(column)], np.int64).reshape(-1, len(BASE))
        failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
        mean = _means(column, known.ratio)
        return [*base.T, failed, mean, ~failed & (mean >= known.threshold)]

    fields = [StructField(n, f.dataType, False) for n, f in zip(names, FIELDS, strict=True)] if names else FIELDS
    return with_arrow_columns(docs, text, docs.columns if keep is None else keep, fields, work)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns."""
    names = [fresh(docs, f"_{f.name}") for f in FIELDS]
    told = score(docs, train(docs, labels), names=names)
    return told.where(names[-1]).select(*[told[c] for c in docs.columns])

