"""WARC archives with an index of every record, read back by coalesced byte ranges.

Writing tasks append one gzip member per record to archives of their own and
return each record's place: archive, offset, length, URL and digest.  That
index is a table; readers select from it, sort by place, join nearby ranges
into one read and cut the records out.  An archive's name is new in each
attempt of a task, so archives of lost or repeated attempts are never listed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import blocks, written
from twinledger.session import scratch_path

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 16 << 20
"""Archive bytes of one reading task, about; a larger archive is read by several."""
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"


def open_store(uri: str):
    """``(filesystem, path)`` of a folder that all executors reach; other stores take a function of their own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else "file://" + uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, first: int | None, first_url: str | None, revisit: bool) -> tuple[bytes, str]:
    """One record's bytes (a gzip member) and the payload's digest."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        head += [("WARC-Refers-To", _name(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        if first_url is not None:
            head.append(("WARC-Refers-To-Target-URI", " ".join(first_url.split())))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + body + b"\r\n\r\n") + packer.flush(), digest


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member that holds one record."""
    text = zlib.decompress(member, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """``page, url, payload, first, first_url, revisit`` of each page.

    Of equal payloads with ``least`` bytes or more the smallest page_id is the
    response.  Rows that repeat that id are responses too, a null id is never
    the smallest unless all are null (then all are responses).  Only digests
    with several rows are joined, by page, so a frequent payload isn't
    gathered anywhere.
    """
    rows = pages.select(pages[page_id].cast("long").alias("page"), pages[url].cast("string").alias("url"),
                        F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary").alias("payload"))
    light = rows.where(F.octet_length("payload") >= least).select("page", "url", F.sha1("payload").alias("sha"))
    firsts = light.groupBy("sha").agg(F.count("*").alias("n"), F.min("page").alias("first"), F.min_by("url", "page").alias("first_url")).where(
        (F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    later = light.select("page", "sha").join(firsts, "sha").where(~F.col("page").eqNullSafe(F.col("first"))).dropDuplicates(["page", "sha"])
    later = later.select(F.col("page").alias("_page"), F.col("sha").alias("_sha"), "first", "first_url")
    joined = rows.withColumn("sha", F.sha1("payload")).join(later, F.col("page").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    return joined.select("page", "url", "payload", "first", "first_url", F.col("_sha").isNotNull().alias("revisit"))


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, store: Callable = open_store) -> DataFrame:
    """Write ``decided`` records to archives in ``folder``; returns the index, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        out, name, size = None, "", 0
        try:
            for block in blocks((b.set_column(2, "payload", b.column(2).cast(pa.binary())) for b in batches), 2):
                rows = []
                for page, url, payload, first, first_url, revisit in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    if out is None or size >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member, digest = record(page, url, payload, first, first_url, revisit)
                    out.write(member)
                    rows.append((name, size, len(member), url, digest, page, "revisit" if revisit else "response"))
                    size += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names=["archive", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return written(records.mapInArrow(run, INDEX), "warc-index")


def ranges(places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """Reads ``(from, to, records)`` that cover sorted ``(offset, length)`` places: near ones share a read."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(places):
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            start, end, held = reads[-1]
            held.append(i)
            reads[-1] = (start, max(end, offset + length), held)
        else:
            reads.append((offset, offset + length, [i]))
    return reads


def read(index: DataFrame, folder: str, payload: bool = False, store: Callable = open_store) -> DataFrame:
    """The records that ``index`` rows select: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    A response's payload is checked against its digest.  With ``payload`` its
    bytes come too (null for revisits, whose response has them).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    width = 6 + payload

    def number(name: str | None) -> int | None:
        told = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(told) if told else None

    def one(member: bytes) -> tuple:
        fields, block = parse(member)
        http, _, body = block.partition(b"\r\n\r\n")
        size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = fields["WARC-Type"] == "revisit"
        if not revisit and (len(body) != size or sha1_base32(body) != digest):
            raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
        row = (number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")))
        return (*row, None if revisit else body) if payload else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        name, file = None, None
        for batch in batches:
            archives, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(archives):
                to = at
                while to < len(archives) and archives[to] == archives[at]:
                    to += 1
                if archives[at] != name:
                    name, file = archives[at], fs.open_input_file(f"{base}/{archives[at]}")
                for start, end, held in ranges(list(zip(offsets[at:to], lengths[at:to], strict=True))):
                    data = file.read_at(end - start, start)
                    rows = [one(data[offsets[at + i] - start : offsets[at + i] - start + lengths[at + i]]) for i in held]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds[:width], strict=True)], names=names[:width])
                at = to

    # The index is small where archives are large: tasks are counted by archive bytes.
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    part = F.floor(F.col("offset") / TASK_BYTES)
    return index.select("archive", "offset", "length").repartition(tasks, "archive", part).sortWithinPartitions("archive", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, then read all archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(decided(pages), folder), folder)
