"""Language identification by multilingual mixture inference.

A text is taken as a mixture of languages.  Each language is a multinomial
over hashed letter n-grams, learned from labelled texts.  Expectation
maximisation estimates the text's language proportions; the set of languages
is the one of highest likelihood after a penalty for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField

from llm.common import blocks, fresh, utf8, with_arrow_columns

GRAM = 3
BUCKETS_LOG2 = 14
SMOOTHING = 0.5
ROUNDS = 8
PENALTY = 3.0
"""Times half the log of the text's n-grams, for each language beyond the first; overlapping n-grams count a letter three times."""
UNKNOWN = "und"

LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
LETTERS[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    """``table[bucket, i]`` is the probability of a bucket in ``languages[i]``; its size is buckets times languages."""

    languages: list[str]
    table: np.ndarray


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter n-grams of a block, and each one's row.

    Other ASCII bytes count as space, as do a text's ends; an n-gram's middle
    byte is a letter's and no n-gram spans two texts.
    """
    own, ends = utf8(pc.utf8_lower(column))
    size = np.diff(ends)
    rows = np.repeat(np.arange(len(column), dtype=np.int32), size + 2)
    data = np.full(len(rows), 32, np.uint8)
    data[np.arange(len(own)) + 2 * np.repeat(np.arange(len(column)), size) + 1] = LETTERS[own]
    if len(data) < GRAM:
        return np.zeros(0, np.int64), rows[:0]
    whole = (rows[: -GRAM + 1] == rows[GRAM - 1 :]) & (data[1:-1] != 32)
    packed = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    packed = packed[whole] * np.uint32(2654435761)
    return (packed >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64), rows[: -GRAM + 1][whole]


def counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, bucket, n`` over all rows whose label is not null; each task adds up its own first."""
    source = labelled.where(labelled[lang].isNotNull()).select(labelled[lang].cast("string").alias("lang"), labelled[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches, 1):
            bucket, row = _grams(block.column(1))
            coded = block.column(0).dictionary_encode()
            code = np.asarray(coded.indices)[row]
            for i, name in enumerate(coded.dictionary.to_pylist()):
                sums.setdefault(name, np.zeros(1 << BUCKETS_LOG2, np.int64))
                sums[name] += np.bincount(bucket[code == i], minlength=1 << BUCKETS_LOG2)
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])

    return source.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of the labelled texts; only languages times buckets numbers reach the driver."""
    found = counts(labelled, text, lang).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    table = np.zeros((1 << BUCKETS_LOG2, len(names)))
    code = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    table[np.asarray(found.column("bucket")).astype(np.int64), code] = np.asarray(found.column("n"))
    table += SMOOTHING
    return Model(names, (table / table.sum(0)).astype(np.float32))


def _mixture(p: np.ndarray, n: np.ndarray, starts: np.ndarray, row: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions per text after some rounds of expectation maximisation."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        share = p * pi[row]
        share *= (n / share.sum(1))[:, None]
        pi = np.add.reduceat(share, starts, axis=0) / total
        pi = np.maximum(pi, np.float32(1e-6) * (pi > 0))
    return pi


def _likelihood(p: np.ndarray, n: np.ndarray, starts: np.ndarray, row: np.ndarray, pi: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n * np.log((p * pi[row]).sum(1)), starts)


def mixtures(bucket: np.ndarray, row: np.ndarray, rows: int, model: Model) -> np.ndarray:
    """Language proportions of each of ``rows`` texts, zero outside the chosen set; all zero without n-grams."""
    kinds = len(model.languages)
    out = np.zeros((rows, kinds), np.float32)
    if not len(bucket) or not kinds:
        return out
    key, n = np.unique((row.astype(np.int64) << BUCKETS_LOG2) | bucket, return_counts=True)
    own = key >> BUCKETS_LOG2
    n = n.astype(np.float32)
    p = model.table[key & ((1 << BUCKETS_LOG2) - 1)]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    some = own[starts]
    row = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(own))))
    single = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
    best = single.argmax(1)
    pi = np.zeros((len(some), kinds), np.float32)
    pi[np.arange(len(some)), best] = 1
    out[some] = pi
    full = _mixture(p, n, starts, row, np.full((len(some), kinds), np.float32(1 / kinds)), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    score = single.max(1)
    fee = PENALTY / 2 * np.log(np.add.reduceat(n, starts))
    open_ = np.ones(len(some), bool)
    for k in range(2, kinds + 1):  # a larger set is tried where the last one was worth its penalty
        at = np.flatnonzero(open_)
        if not len(at):
            break
        inside = open_[row]
        n_k, p_k = n[inside], p[inside]
        row_k = (np.cumsum(open_) - 1)[row[inside]]
        starts_k = np.flatnonzero(np.concatenate(([True], row_k[1:] != row_k[:-1])))
        pi = np.zeros((len(at), kinds), np.float32)
        np.put_along_axis(pi, order[at, :k], np.maximum(np.take_along_axis(full[at], order[at, :k], 1), 1e-3), 1)
        pi = _mixture(p_k, n_k, starts_k, row_k, pi / pi.sum(1, keepdims=True), ROUNDS // 2)
        gain = _likelihood(p_k, n_k, starts_k, row_k, pi) - fee[at]
        better = gain > score[at]
        out[some[at[better]]] = pi[better]
        score[at[better]] = gain[better]
        open_[at[~better]] = False
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
             names: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` with the main language, its proportion and the languages found.

    A text that is null, empty or without a letter, and any text when the
    model has no language, gets ``und``, 0.0 and no languages.  Ties go to the
    language first by name.  Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))  # buckets times languages numbers

    def work(column: pa.Array) -> list:
        known = Model(*shared.value)
        bucket, row = _grams(column)
        pi = mixtures(bucket, row, len(column), known)
        labels = np.array([*known.languages, UNKNOWN], object)
        has = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)) & (pi.sum(1) > 0)
        top = np.where(has, pi.argmax(1), len(known.languages)) if known.languages else np.zeros(len(column), np.int64)
        score = np.where(has, pi.max(1), 0.0) if known.languages else np.zeros(len(column))
        order = np.argsort(-pi, axis=1, kind="stable")
        found = [[known.languages[j] for j in order[i] if pi[i, j] > 0] if has[i] else [] for i in range(len(column))]
        return [pa.array(labels[top].tolist(), pa.string()), np.clip(score.astype(float), 0, 1), pa.array(found, pa.list_(pa.string()))]

    fields = [StructField(names[0], StringType(), False), StructField(names[1], DoubleType(), False), StructField(names[2], ArrayType(StringType()))]
    return with_arrow_columns(docs, text, docs.columns if keep is None else keep, fields, work)


def held_out(doc_id: F.Column) -> F.Column:
    """One fifth of the ids, by their own checksum; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out fifth; a null id is never learned from."""
    return docs.where(docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))


def keep_known(docs: DataFrame, least: float = 1 / 3) -> DataFrame:
    """Rows whose text has a main language with at least ``least`` of its n-grams.

    When no row is labelled nothing can be judged and all rows stay.
    """
    model = train(training_rows(docs))
    if not model.languages:
        return docs
    names = tuple(fresh(docs, c) for c in ("_lang", "_score", "_langs"))
    told = identify(docs, model, names=names)
    return told.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*[told[c] for c in docs.columns])
