"""CSV files whose quoted fields hold line breaks, read by many tasks.

A file is cut at bytes, so a task can't know whether its part begins inside
quotes.  The first pass reads the parts and tells for each what state it ends
in if it begins outside quotes, and if inside: two cases, which compose.  A
scan over these, one row a part, gives every part its state and the part in
which an open record began.  The second pass cuts records; one that spans
parts is put together from its pieces.  Records are parsed by Spark.

Quotes are as in RFC 4180: a field that begins with one ends at the next that
isn't doubled; one elsewhere in a field is a character.  CRLF counts as a line
break, also within quotes, where it is read as LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_OPTIONS = {"escape": '"'}
"""A quote within quotes is written twice."""


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Is a line's end inside quotes, if its start is or not."""
    at, size = 0, len(line)
    while True:
        if not inside:
            while not line.startswith('"', at):  # fields without quotes
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
            at += 1
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(delimiter, at) + 1  # what follows a closed field up to the delimiter is its own
        if not at or at > size:
            return False
        inside = False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.coalesce("value", F.lit("")).alias("line"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


PARTS = "file string, part long, out boolean, `in` boolean, whole boolean"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: does it end inside if begun outside, or inside; and does it, begun inside, hold no record's end."""
    now: tuple | None = None
    out = in_ = whole = False

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": now[0], "part": now[1], "out": out, "in": in_, "whole": whole}],
                                          pa.schema([("file", pa.string()), ("part", pa.int64()), ("out", pa.bool_()), ("in", pa.bool_()), ("whole", pa.bool_())]))

    for file, part, line in _rows(batches):
        if (file, part) != now:
            if now:
                yield told()
            now, out, in_, whole = (file, part), False, True, True
        if '"' in line:
            same = out == in_
            out = ends_inside(line, out)
            in_ = out if same else ends_inside(line, in_)
        whole = whole and in_
    if now:
        yield told()


def _owners(table: pa.Table) -> pa.Table:
    """The parts that begin inside quotes, and the part in which their first record began."""
    out = {"file": [], "part": [], "owner": []}
    inside, owner = False, 0
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        if inside:
            for key, value in (("file", row["file"]), ("part", row["part"]), ("owner", owner)):
                out[key].append(value)
        if not (inside and row["whole"]):
            owner = row["part"]
        inside = row["in"] if inside else row["out"]
    return pa.table(out, pa.schema([("file", pa.string()), ("part", pa.int64()), ("owner", pa.int64())]))


def _cut(owners, skip_first: bool):
    """Whole records (``owner`` null), and the pieces of those that span parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("part", pa.int64()), ("record", pa.string()), ("head", pa.bool_())])
        rows: list[tuple] = []
        now: tuple | None = None
        held: list[str] = []
        inside, owner, skip = False, None, False

        def done(text: str, owner_: int | None) -> None:
            nonlocal skip
            if owner_ is None:
                if text in ("", "\r"):  # blank lines are no records
                    return
                if skip:
                    skip = False
                    return
            rows.append((now[0], owner_, now[1], text, skip))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
            rows.clear()
            return made

        for file, part, line in _rows(batches):
            if (file, part) != now:
                if held:
                    done("\n".join(held), now[1] if owner is None else owner)
                    held = []
                now = (file, part)
                owner = owners.value.get(now)
                inside = owner is not None
                skip = skip_first and part == 0
                if part == 0:
                    line = line.removeprefix("﻿")
            held.append(line)
            if inside or '"' in line:
                inside = ends_inside(line, inside)
            if not inside:
                done("\n".join(held), owner)
                held, owner = [], None
            if len(rows) >= 10_000:
                yield batch()
        if held:
            done("\n".join(held), now[1] if owner is None else owner)
        if rows:
            yield batch()

    return run


def csv_records(spark: SparkSession, path: str | list[str], skip_first: bool = False) -> DataFrame:
    """``record``: the text of each record, blank lines left out, without each file's first if ``skip_first``.

    What is broadcast is a row for each part that begins inside quotes.
    """
    lines = _lines(spark, path)
    told = lines.mapInArrow(_parts, PARTS).groupBy("file").applyInArrow(_owners, "file string, part long, owner long").toArrow()
    owners = spark.sparkContext.broadcast({(r["file"], r["part"]): r["owner"] for r in told.to_pylist()})
    cut = lines.mapInArrow(_cut(owners, skip_first), "file string, owner long, part long, record string, head boolean")
    pieces = cut.filter(F.col("owner").isNotNull()).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("part", "record"))).alias("p"), F.max("head").alias("head")).filter(~F.col("head"))
    joined = pieces.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    every = cut.filter(F.col("owner").isNull()).select("record").unionByName(joined)
    return every.select(F.regexp_replace(F.regexp_replace("record", r"\r\z", ""), "\r\n", "\n").alias("record"))


def scan_csv_split(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """CSV with every field a string, as ``scan_csv`` reads it, by many tasks; rows come in no set order.

    Names are the first file's first record.  Blank lines are no records, a
    short record's missing fields are null, and further ones are left out.
    Old files that end lines with CR alone are not for this reader.
    """
    schema = spark.read.csv(path, header=header, multiLine=True, **CSV_OPTIONS).schema
    if not schema.fields:
        return spark.createDataFrame([], schema)
    records = csv_records(spark, path, skip_first=header)
    row = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(schema.fields))), CSV_OPTIONS)
    return records.select(row.alias("r")).select("r.*").toDF(*schema.names)
