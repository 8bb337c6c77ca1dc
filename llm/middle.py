"""Fill-in-middle: texts cut at two drawn ranks and put together for infilling.

The cut ranks count units (code points, words or lines), while lengths are told
in code points and the text is cut at bytes.  An indexable skip list answers
all three: a node of an express lane carries the units, the code points and the
bytes up to the next node, and going down from the sparsest lane by accumulated
widths reaches the unit of a given rank.  The bottom lane is the text itself:
only the units of the one node that is reached are looked at.  Gaps between
nodes are geometric draws, as in a skip list whose towers are drawn unit by
unit, and the list of a text is built in one pass over chunks of its bytes, so
a very long text needs its own bytes and about one byte a unit besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from llm.common import arrow_type, blocks, fresh, texts

# The markers, and the share of texts that stay plain and of those cut that put the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

UNITS = ("code_points", "words", "lines")
GAP = 64
"""Units between two nodes of a lane, or nodes of the lane below, on average."""
CHUNK = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unit_starts(data: np.ndarray, unit: str, before: int | None) -> np.ndarray:
    """Where units begin in a stretch of UTF-8; ``before`` is the byte in front of it, None at a text's start.

    A word takes the blanks after it along; blanks at a text's start are a
    unit of their own.  A line takes its line break along.
    """
    if unit == "code_points":
        return np.flatnonzero((data & 0xC0) != 0x80)
    last = np.empty(len(data), np.uint8)
    last[1:] = data[:-1]
    last[:1] = 0x0A if before is None else before
    if unit == "words":
        marks = ~BLANK[data] & BLANK[last]
    elif unit == "lines":
        marks = last == 0x0A
    else:
        raise ValueError(f"unit must be one of {UNITS}")
    if before is None:
        marks[:1] = True
    return np.flatnonzero(marks)


class SkipList:
    """An indexable skip list over a text's units.

    ``lanes[0]`` is the sparsest; each lane is an array of nodes' widths in
    units, code points and bytes, and ``below`` the number of nodes of the
    next lane that each node spans.
    """

    def __init__(self, text: bytes, unit: str = "code_points", gap: int = GAP, chunk: int = CHUNK):
        self.text, self.unit = text, unit
        rng = np.random.default_rng(len(text))
        data = np.frombuffer(text, np.uint8)
        found: list[np.ndarray] = []
        units = points = 0
        to_next = 0  # units until the next node
        for at in range(0, len(data), chunk):
            part = data[at : at + chunk]
            starts = unit_starts(part, unit, int(data[at - 1]) if at else None)
            first = (part & 0xC0) != 0x80 if unit != "code_points" else None
            picked: list[np.ndarray] = []
            while to_next < len(starts):
                gaps = rng.geometric(1 / gap, max(1, (len(starts) - to_next) // gap + 1))
                places = to_next + np.concatenate(([0], np.cumsum(gaps)))
                picked.append(places[:-1][places[:-1] < len(starts)])
                inside = int((places < len(starts)).sum())
                to_next = int(places[inside]) if inside < len(places) else int(places[-1])
            to_next -= len(starts)
            if picked:
                place = np.concatenate(picked)
                where = starts[place]
                before = np.concatenate(([0], np.cumsum(first)))[where] if first is not None else place
                found.append(np.stack([units + place, points + before, at + where], axis=1))
            units += len(starts)
            points += int(first.sum()) if first is not None else len(starts)
        self.units, self.points = units, points
        end = np.array([[units, points, len(text)]], np.int64)
        marks = np.concatenate([*found, end]) if found else end
        lane = np.diff(marks, axis=0)
        self.lanes: list[np.ndarray] = [lane]
        self.below: list[np.ndarray] = []
        while len(lane) > gap:
            gaps = rng.geometric(1 / gap, 2 * len(lane) // gap + 16)
            heads = np.concatenate(([0], np.cumsum(gaps)))
            heads = heads[heads < len(lane)]
            self.below.insert(0, np.diff(np.append(heads, len(lane))))
            lane = np.add.reduceat(lane, heads, axis=0)
            self.lanes.insert(0, lane)

    def find(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the unit with this rank (the text's end for the number of units)."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        if rank == self.units:
            return self.points, len(self.text)
        passed = np.zeros(3, np.int64)
        low, high = 0, len(self.lanes[0])
        for depth, lane in enumerate(self.lanes):
            ahead = np.cumsum(lane[low:high, 0]) + passed[0]
            steps = int(np.searchsorted(ahead, rank, "right"))  # nodes that end at or before the rank
            passed = passed + lane[low : low + steps].sum(axis=0)
            node = low + steps
            if depth < len(self.below):
                spans = self.below[depth]
                low = int(spans[:node].sum())
                high = low + int(spans[node])
        units, points, at = map(int, passed)
        width = int(self.lanes[-1][node, 2])
        data = np.frombuffer(self.text, np.uint8, width, at)
        starts = unit_starts(data, self.unit, self.text[at - 1] if at else None)
        place = int(starts[rank - units])
        return points + int(((data[:place] & 0xC0) != 0x80).sum()), at + place


def draws(doc_id: str | int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on the seed and the id alone; a null id counts as an empty one."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(told[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut(text: bytes, doc_id: str | int | None, unit: str = "code_points", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
        seed: int = 1) -> tuple[bytes, str, int, int | None, int | None, int]:
    """Output, form, units, and the prefix's and the middle's code points (None where plain), and the text's code points."""
    if not text:
        return b"", "plain", 0, None, None, 0
    index = SkipList(text, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if h3 % 100 >= plain_from or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return text, "plain", index.units, None, None, index.points
    one, two = h1 % (index.units + 1), h2 % (index.units + 1)
    (chars, a), (upto, b) = index.find(min(one, two)), index.find(max(one, two))
    if h4 % 100 < spm_below:
        made, form = b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])), "spm"
    else:
        made, form = b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])), "psm"
    return made, form, index.units, chars, upto - chars, index.points


def restored(output: bytes, form: str) -> bytes:
    """The text that ``cut`` got; no text that was cut holds a marker, so each marker is found where it was put."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(first):
        raise ValueError(f"an output of form {form} must start with {first.decode()}")
    x = output.index(second, len(first))
    y = output.index(MIDDLE, x + len(second))
    head, tail, middle = output[len(first) : x], output[x + len(second) : y], output[y + len(MIDDLE) :]
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


NEW = [("fim_output", StringType()), ("fim_form", StringType()), ("fim_units", LongType()), ("fim_prefix_chars", LongType()), ("fim_middle_chars", LongType()),
       ("fim_chars", LongType())]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "code_points", plain_from: int = PLAIN_FROM,
              spm_below: int = SPM_BELOW, seed: int = 1) -> DataFrame:
    """All columns of ``docs`` beside the transformed text, its form and where it was cut.

    The new columns are ``fim_output``, ``fim_form`` (plain, psm or spm),
    ``fim_units``, ``fim_prefix_chars`` and ``fim_middle_chars`` (code points;
    null if plain) and ``fim_chars``; each gets a longer name where ``docs``
    has its name.  A row's result depends on its own id and text alone, so
    repeated rows give equal rows and a retried task gives the same.  A null
    or empty text gives an empty plain output; rows with a null id share one
    draw.  A text that holds a marker stays plain.  Equal cut ranks give an
    empty middle.  Texts of any length are cut whole; an empty table gives an
    empty result.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    fields = [StructField(fresh(docs, name), kind) for name, kind in NEW]
    schema = StructType(docs.schema.fields + fields)
    n = len(docs.columns)
    names, kinds = schema.names, [arrow_type(f) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, n + 1):
            ids = block.column(n).to_pylist()
            made = [cut(t, i, unit, plain_from, spm_below, seed) for i, t in zip(ids, texts(block.column(n + 1)), strict=True)]
            new = [pa.array(x, pa.binary()).cast(kind) if kind == pa.string() and x and isinstance(x[0], bytes) else pa.array(x, kind)
                   for x, kind in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*block.columns[:n], *new], names=names)

    return docs.select("*", docs[doc_id].cast("string").alias(fresh(docs, "_fim_id")), docs[text].cast("string").alias(fresh(docs, "_fim_text"))).mapInArrow(run, schema)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` the digests of its transformed text and of the text put together from it again."""
    made = transform(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            outputs = texts(block.column(1))
            whole = [restored(o, f) for o, f in zip(outputs, block.column(2).to_pylist(), strict=True)]
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in one], pa.string()) for one in (outputs, whole)]
            yield pa.RecordBatch.from_arrays([block.column(0), *block.columns[3:], block.column(2), *digests],
                                             names=["doc_id", "n", "prefix_chars", "middle_chars", "form", "output_sha256", "restored_sha256"])

    told = made.select("doc_id", "fim_output", "fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars")
    kind = told.schema["doc_id"].dataType.simpleString()
    return told.mapInArrow(run, f"doc_id {kind}, n long, prefix_chars long, middle_chars long, form string, output_sha256 string, restored_sha256 string").select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def oracle() -> str:
    """DuckDB SQL for ``measured`` over ``documents``: cuts by code points, without any index."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH told AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS r2,
  CASE WHEN n = 0 OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {PLAIN_FROM} THEN 'plain'
       WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM told),
parts AS (SELECT *, least(r1, r2) AS a, greatest(r1, r2) AS b FROM drawn),
cut AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
         ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""
