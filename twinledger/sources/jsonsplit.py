"""JSON files that hold one array of records, or records one after another, read by many tasks.

A file is cut at closing braces, each of which may end a record, close
something inside one, or be a character of a string.  The first pass reads the
parts and tells for each, begun outside a string and begun inside, how it ends,
how far the depth moves and how low it gets at a brace; the two cases compose.
A scan over these, one row a part, gives every part its state and the part in
which an open record began.  The second pass cuts records; one that spans
parts is put together from its pieces.  Records are parsed by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.session import scratch_path

BLANK = " \t\r\n"
ESCAPED = re.compile(r"\\.", re.DOTALL)
HIGH = 1 << 62
"""The lowest depth where there is no brace outside strings."""
BATCH_CHARS = 4 << 20
BATCH_ROWS = 256


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def moves(piece: str) -> tuple[bool, int, int]:
    """Does a piece flip between inside and outside a string; how far its depth moves, begun outside and begun inside."""
    if "\\" in piece:
        piece = ESCAPED.sub("", piece)
    if '"' not in piece:
        return False, _depth(piece), 0
    runs = piece.split('"')
    return len(runs) % 2 == 0, sum(map(_depth, runs[::2])), sum(map(_depth, runs[1::2]))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.coalesce("value", F.lit("")).alias("piece"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: what a task holds as Python values stays small beside its batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for part in slices(batches):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _clean(text: str) -> str:
    return text.lstrip("﻿" + BLANK)


TOLD = pa.schema([("file", pa.string()), ("part", pa.int64()), ("root", pa.string()), ("flip", pa.bool_()),
                  ("move0", pa.int64()), ("move1", pa.int64()), ("low0", pa.int64()), ("low1", pa.int64())])
TOLD_SQL = "file string, part long, root string, flip boolean, move0 long, move1 long, low0 long, low1 long"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part, each piece taken with its closing brace; index 0 is for a part begun outside a string, 1 for inside."""
    now, root = None, ""
    inside, depth, low = [False, True], [0, 0], [HIGH, HIGH]

    def row() -> pa.RecordBatch:
        values = (*now, root, inside[0], *depth, *low)
        return pa.RecordBatch.from_pylist([dict(zip(TOLD.names, values, strict=True))], TOLD)

    for file, part, piece in _rows(batches):
        if (file, part) != now:
            if now:
                yield row()
            now, root = (file, part), _clean(piece)[:1]
            inside, depth, low = [False, True], [0, 0], [HIGH, HIGH]
        flip, *moved = moves(piece)
        for case in (0, 1):
            depth[case] += moved[inside[case]]
            inside[case] ^= flip
            if not inside[case]:  # the brace that ended the piece
                depth[case] -= 1
                low[case] = min(low[case], depth[case])
    if now:
        yield row()


OPEN = pa.schema([("file", pa.string()), ("part", pa.int64()), ("base", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()),
                  ("owner", pa.int64()), ("tail", pa.bool_())])
OPEN_SQL = "file string, part long, base long, inside boolean, depth long, owner long, tail boolean"


def _states(table: pa.Table) -> pa.Table:
    """For each part of one file: the depth of its records, its state, where its open record began, does its last piece lack a brace."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    file, root = rows[0]["file"], rows[0]["root"]
    if root not in ("[", "{", "", "}"):
        raise ValueError(f"{file} holds no JSON array or object")
    base = int(root == "[")
    out, inside, depth, owner = [], False, 0, None
    for row in rows:
        first = row["part"] == rows[0]["part"]
        open_ = not first and (inside or depth != base)
        out.append({"file": file, "part": row["part"], "base": base, "inside": inside, "depth": depth, "owner": owner if open_ else None, "tail": False})
        case = int(inside)
        if not open_ or depth + row[f"low{case}"] <= base:
            owner = row["part"]
        depth += row[f"move{case}"]
        inside = inside ^ row["flip"]
    if root and (inside or depth not in (0, -1)):
        raise ValueError(f"{file} ends within a JSON value")
    out[-1]["tail"] = depth == -1
    return pa.Table.from_pylist(out, OPEN)


CUT = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("part", pa.int64()), ("record", pa.string())])
CUT_SQL = "file string, owner long, part long, record string"


def _cut(states):
    """Whole records (``owner`` null), and the pieces of those that span parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        now, waiting = None, None
        held: list[str] = []
        base, inside, depth, owner, tail = 0, False, 0, None, False

        def put(owner_: int | None, text: str) -> None:
            nonlocal size
            rows.append((now[0], owner_, now[1], text))
            size += len(text)

        def take(piece: str) -> None:
            nonlocal inside, depth, owner
            held.append(piece)
            flip, *moved = moves(piece)
            depth += moved[inside]
            inside ^= flip
            if not inside:
                depth -= 1
                if depth == base:
                    put(owner, "}".join(held) + "}")
                    held.clear()
                    owner = None

        def close() -> None:
            """The part's last piece, and what is still open behind it."""
            if not tail:
                take(waiting)
                if held:
                    put(now[1] if owner is None else owner, "}".join(held) + "}")
            elif set(_clean(waiting)) - set("[]" + BLANK):
                raise ValueError(f"{now[0]}: a JSON array holds an element that is no object")
            held.clear()

        def batch() -> pa.RecordBatch:
            nonlocal size
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CUT, strict=True)], schema=CUT)
            rows.clear()
            size = 0
            return made

        for file, part, piece in _rows(batches):
            if (file, part) != now:
                if now:
                    close()
                now = (file, part)
                base, inside, depth, owner, tail = states.value[now]
            else:
                take(waiting)
            waiting = piece
            if size >= BATCH_CHARS:
                yield batch()
        if now:
            close()
        if rows:
            yield batch()

    return run


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records without what parts them, on one line each; what is no object is an error."""
    for batch in slices(batches):
        out = []
        for text in batch.column(0).to_pylist():
            record = _clean(text)
            if record[:1] in ("[", ","):
                record = record[1:].lstrip(BLANK)
            if record[:1] != "{":
                raise ValueError("a JSON array holds an element that is no object")
            out.append(record.replace("\r", " ").replace("\n", " ") if "\n" in record or "\r" in record else record)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record``: the text of each record, on one line.

    A file is an array of objects, or objects one after another (one object,
    or JSON lines).  An empty or blank file and an empty array hold none.  A
    file that ends within a value, or holds an element that is no object, is
    an error and never read in part; objects that lack only their last brace
    at the very end are read as closed.  What is broadcast is one row a part.
    """
    pieces = _pieces(spark, path)
    told = pieces.mapInArrow(_told, TOLD_SQL).groupBy("file").applyInArrow(_states, OPEN_SQL).toArrow()
    states = spark.sparkContext.broadcast(
        {(r["file"], r["part"]): (r["base"], r["inside"], r["depth"], r["owner"], r["tail"]) for r in told.to_pylist()})
    cut = pieces.mapInArrow(_cut(states), CUT_SQL)
    spread = cut.filter(F.col("owner").isNotNull()).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("part", "record"))).alias("p"))
    joined = spread.select(F.array_join(F.transform("p", lambda x: x["record"]), "").alias("record"))
    return cut.filter(F.col("owner").isNull()).select("record").unionByName(joined).mapInArrow(_checked, "record string")


def scan_json_split(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """JSON records as ``scan_json`` reads them, by many tasks even where one array is a whole file; rows come in no set order.

    With a schema the records are parsed as they are cut.  Without one they
    are written once as JSON lines in the shared folder, and Spark infers the
    schema from there.
    """
    records = json_records(spark, path)
    if schema is not None:
        return records.select(F.from_json("record", schema).alias("r")).select("r.*")
    lines = scratch_path(spark, "json-lines")
    records.write.text(lines)
    return spark.read.json(lines)
