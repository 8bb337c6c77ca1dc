"""Document fingerprints as Merkle trees, in DataFrame functions alone.

Leaves are pieces of a paragraph: up to ``PIECE`` characters, or fewer when a
sentence or line ends.  Paragraphs (lines) hash their pieces, sections hash
their paragraphs, the root hashes the sections.  Section bounds depend on the
paragraphs' hashes, so an insertion shifts no later section.  Equal roots mean
equal texts; where roots differ, differing sections, paragraphs and pieces
locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import fresh

PIECE = 32
SECTION = 4
"""Paragraphs of a section, about."""
BUCKET_BYTES = 32 << 20
CELLS = 1 << 17
"""Cells of equal width in which ids are counted; their fixed number bounds what is broadcast."""

PIECES = r"[^.!?\n]{0,%d}+[.!?\n]++|[^.!?\n]{1,%d}+" % (PIECE, PIECE)


def leaves(text: Column) -> Column:
    """Hashes of a text's pieces, in order; the sign of ``line end`` is kept in a paragraph's last one."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.struct(F.xxhash64(p).alias("h"), F.endswith(p, F.lit("\n")).alias("last")))


def tree(pieces: Column) -> Column:
    """``root:section/section/...``; a section is ``paragraph;paragraph``, a paragraph ``piece,piece`` in hexadecimal."""
    chain = F.array_join(F.transform(pieces, lambda p: F.concat(F.lower(F.lpad(F.hex(p["h"]), 16, "0")), F.when(p["last"], ";").otherwise(","))), "")
    paragraphs = F.split(chain, ";")
    closed = F.transform(paragraphs, lambda p: F.concat(p, F.when(F.pmod(F.xxhash64(p), F.lit(SECTION)) == 0, "/").otherwise(";")))
    return F.array_join(closed, "")


def root(chain: Column) -> Column:
    """The root's hash: of the sections' hashes, each of its paragraphs' hashes, each of its pieces."""
    node = lambda x: F.sha2(x, 256)
    sections = F.transform(F.split(chain, "/"), lambda s: node(F.array_join(F.transform(F.split(s, ";"), node), "")))
    return F.substring(node(F.array_join(sections, "")), 1, 32)


def fingerprint(chain: Column) -> Column:
    """A ``tree`` as text: the root and, after a colon, all pieces (8 digits each) in their paragraphs and sections."""
    return F.concat(root(chain), F.lit(":"), F.regexp_replace(chain, "([0-9a-f]{8})[0-9a-f]{8},?", "$1"))


def likeness(x: Column, y: Column) -> Column:
    """Twice the pieces in common over all pieces of two lists without repeats; two empty ones are 1."""
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def located(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of fingerprint ``b`` that fingerprint ``a`` lacks: where an edit is."""
    parts = lambda f: F.split(F.translate(F.substring_index(f, ":", -1), "/", ";"), ";")
    return F.array_compact(F.transform(parts(b), lambda p, i: F.when(~F.array_contains(parts(a), p), i)))


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and each text's fingerprint; null counts as empty.

    Where ``docs`` has a column of that name, the new one's is lengthened by underscores.
    """
    column, chain = fresh(docs, column), fresh(docs, "_chain")
    held = docs.withColumn(chain, tree(leaves(F.coalesce(docs[text].cast("string"), F.lit("")))))
    return held.withColumn(column, fingerprint(F.col(chain))).drop(chain)


def _bucketed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``bucket``, ascending with ``k`` and about ``BUCKET_BYTES`` of text each; the buckets, twice ``CELLS`` at most."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // CELLS))
    own = F.floor((F.col("doc_id").cast("decimal(38,0)") - F.lit(low)) / F.lit(width)).cast("long")
    # Null ids lie below all others, by their texts' hashes.
    rows = rows.withColumn("cell", F.coalesce(own, F.shiftright("h", 47) - F.lit(CELLS)))
    sizes = rows.groupBy("cell").agg(F.sum(F.octet_length("t") + 64).alias("bytes"))
    cells = sizes.select("cell", F.floor((F.sum("bytes").over(Window.orderBy("cell")) - F.col("bytes")) / BUCKET_BYTES).alias("bucket"))
    return rows.join(F.broadcast(cells), "cell").drop("cell"), cells.select("bucket").distinct()


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, t`` with ``next_t``, the text of the next row by descending id; after the last comes the first.

    A null id counts as the smallest.  Rows that repeat an id follow each
    other by their texts' hashes.  Texts are exchanged once, in buckets of
    neighbouring ids; each bucket gets the next one's first row as a last one.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[doc_id].cast("long"), F.lit(-(1 << 63))).alias("k"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    placed, buckets = _bucketed(rows)
    placed = placed.select("bucket", "doc_id", "k", "h", "t")
    heads = placed.groupBy("bucket").agg(F.max(F.struct("k", "h")).alias("head"))
    # One row per bucket: the one before in ascending order follows it here; after the lowest comes the highest.
    after = buckets.select("bucket", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(0)))).alias("after"))
    wanted = after.join(heads.select(F.col("bucket").alias("after"), "head.k", "head.h"), "after").select(F.col("bucket").alias("for"), "after", "k", "h")
    keys = [F.col("bucket") == F.col("after"), placed.k == wanted.k, placed.h == wanted.h]
    ends = placed.join(F.broadcast(wanted), keys).select(F.col("for").alias("bucket"), "t").dropDuplicates(["bucket"])
    rows = placed.select("bucket", F.lit(0).alias("end"), "doc_id", "k", "h", "t").unionByName(
        ends.select("bucket", F.lit(1).alias("end"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"), "t"))
    window = Window.partitionBy("bucket").orderBy("end", F.desc("k"), F.desc("h"))
    return rows.withColumn("next_t", F.lead("t").over(window)).where("end = 0").select("doc_id", "t", "next_t")


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    The edited text has its last third of code points replaced by as many
    first ones of the next document.  Null texts are empty; a single document
    is its own next; an empty table gives no row.  Other columns are ignored.
    """
    third = F.floor(F.length("t") / 3).cast("int")
    rows = with_next(docs, doc_id, text).select(
        "doc_id", "t", "next_t", F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - third), F.substring(F.col("next_t"), F.lit(1), third)).alias("edited"))
    # Each step names what the next one uses more than once, so nothing is computed twice.
    rows = rows.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       leaves(F.col("t")).alias("p"), leaves(F.col("edited")).alias("q"), leaves(F.col("next_t")).alias("r"))
    plain = lambda c: F.array_distinct(F.transform(c, lambda x: x["h"]))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", tree(F.col("p")).alias("tp"), tree(F.col("q")).alias("tq"),
                       plain("p").alias("p"), plain("q").alias("q"), plain("r").alias("r"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("tp")).alias("fingerprint"), fingerprint(F.col("tq")).alias("edited_fingerprint"),
        likeness(F.col("p"), F.col("q")).alias("near_edited"), likeness(F.col("p"), F.col("r")).alias("near_next"))
