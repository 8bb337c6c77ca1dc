"""Reading records in, writing differences out, streams of files."""

from __future__ import annotations

import json
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from twinledger.checks import tables as t
from twinledger.checks.comparing import (
    MISSING_SQL, ONLY_A, ONLY_B, RULE_ROWS_SQL, RULESET_MISSING_SQL, missing_diff_rows, to_ruleset_diff,
)
from twinledger.checks.registry import query
from twinledger.functions.ids import parse_id_spec
from twinledger.model import RULESET_DIFF_COLUMNS, SideConfig
from twinledger.operators import records, sinks
from twinledger.session import scratch_path
from twinledger.sources import files, results
from twinledger.sources.csvsplit import CSV_OPTIONS, scan_csv_split
from twinledger.sources.jsonsplit import scan_json_split, slices
from twinledger.streaming import polling


@query("scan_csv", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, md5(text) AS text FROM documents""")
def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    t.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").write.csv(
        path, header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **CSV_OPTIONS
    )
    return files.scan_csv(spark, path).select("doc_id", "lang", "source", F.md5("text").alias("text"))


@query("scan_csv_split", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, md5(replace(text, chr(13) || chr(10), chr(10))) AS text FROM documents""")
def csv_split(spark, sf_dir):
    """Whole texts with their line breaks and quotes, read by as many tasks as the files have parts."""
    path = scratch_path(spark, "csv")
    t.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").write.csv(
        path, header=True, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **CSV_OPTIONS
    )
    return scan_csv_split(spark, path).select("doc_id", "lang", "source", F.md5("text").alias("text"))


@query("scan_json", """
SELECT o_orderkey AS key, o_orderstatus AS status, o_custkey AS custkey, o_orderpriority AS priority FROM orders""")
def scan_json(spark, sf_dir):
    path = scratch_path(spark, "json")
    t.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.struct(F.col("o_orderstatus").alias("status"),
                 F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority")).alias("inner"))
        .alias("node"),
    ).write.json(path)
    read = files.scan_json(spark, path, json_lines=True)
    return read.select("key", "node.status", "node.inner.custkey", "node.inner.priority")


@query("scan_json_split", """
SELECT doc_id, lang, source, md5(text) AS text FROM documents""")
def json_split(spark, sf_dir):
    """Whole texts out of files that hold one array each, read by as many tasks as the files have parts."""
    path = scratch_path(spark, "json")
    rows = t.table(spark, sf_dir, "documents").select(
        F.to_json(F.struct("doc_id", F.struct("lang", "source").alias("told"), F.array("text").alias("texts"))).alias("record"))

    def arrays(batches):
        mark = "["
        for batch in slices(batches):
            marks = [mark] + [","] * (batch.num_rows - 1) if batch.num_rows else []
            mark = "," if marks else mark
            yield pa.RecordBatch.from_arrays([pa.array([m + r for m, r in zip(marks, batch.column(0).to_pylist(), strict=True)], pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    rows.mapInArrow(arrays, "value string").write.text(path)
    read = scan_json_split(spark, path, "doc_id long, told struct<lang: string, source: string>, texts array<string>")
    return read.select("doc_id", "told.lang", "told.source", F.md5(F.col("texts")[0]).alias("text"))


@query("payload_shape_guard", r"""
WITH f AS (
  SELECT 'e' || event_id || '.json' AS file_name, '  ' || props AS head, CASE WHEN event_type = 'click' THEN 'CSV' ELSE 'JSON' END AS declared_type FROM events
  UNION ALL SELECT 'p' || page_id, html, CASE WHEN contains(url, 'https') THEN 'json' ELSE 'csv' END FROM pages
  UNION ALL SELECT 's' || p_partkey, '{"$schema":"x","PROPERTIES":{"' || p_name || '":{}}}', CASE WHEN p_size < 25 THEN 'CSV' ELSE 'JSON' END FROM part
  UNION ALL SELECT 'b' || c_custkey, CASE WHEN c_acctbal < 0 THEN '   ' ELSE c_name END, 'JSON' FROM customer),
g AS (SELECT *, CASE WHEN trim(head) = '' THEN NULL
        WHEN substring(trim(head), 1, 1) IN ('{', '[') AND contains(lower(head), '"$schema"') AND contains(lower(head), '"properties"') THEN 'JSON_SCHEMA'
        WHEN substring(trim(head), 1, 1) IN ('{', '[') THEN 'JSON' ELSE 'OTHER' END AS shape FROM f)
SELECT file_name, shape, CASE
  WHEN upper(declared_type) = 'CSV' AND shape IN ('JSON', 'JSON_SCHEMA') THEN 'Web expects CSV data, but ' || file_name || ' looks like '
       || CASE WHEN shape = 'JSON' THEN 'JSON' ELSE 'a JSON Schema document' END || '. Upload the source data file for this saved run instead.'
  WHEN upper(declared_type) = 'JSON' AND shape = 'OTHER' THEN 'Web expects JSON data, but ' || file_name
       || ' does not look like JSON. Upload the source data file for this saved run instead.'
  WHEN upper(declared_type) = 'JSON' AND shape = 'JSON_SCHEMA' THEN 'Web expects JSON records, but ' || file_name
       || ' looks like a JSON Schema document. Upload the source data file for this saved run instead of the schema definition.' END AS error
FROM g""")
def payload_shape_guard(spark, sf_dir):
    def files_of(name, prefix, key, head, declared, suffix=""):
        file_name = F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(suffix))
        return t.table(spark, sf_dir, name).select(
            file_name.alias("file_name"), head.alias("head"), declared.alias("declared_type")
        )

    staged = (
        files_of("events", "e", "event_id", F.concat(F.lit("  "), F.col("props")),
                 F.when(F.col("event_type") == "click", "CSV").otherwise("JSON"), ".json")
        .union(files_of("pages", "p", "page_id", F.col("html"),
                        F.when(F.contains(F.col("url"), F.lit("https")), "json").otherwise("csv")))
        .union(files_of("part", "s", "p_partkey",
                        F.concat(F.lit('{"$schema":"x","PROPERTIES":{"'), F.col("p_name"), F.lit('":{}}}')),
                        F.when(F.col("p_size") < 25, "CSV").otherwise("JSON")))
        .union(files_of("customer", "b", "c_custkey", F.when(F.col("c_acctbal") < 0, "   ").otherwise(F.col("c_name")),
                        F.lit("JSON")))
        .withColumn("label", F.lit("Web"))
    )
    return files.payload_shape_guard(staged).select("file_name", "shape", "error")


@query("extract_window", """
SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 12:00:00'""")
def extract_window(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    return files.extract_window(events, "ts", datetime(2024, 1, 5), datetime(2024, 1, 12, 12)).select(
        "event_id", "user_id", "event_type"
    )


@query("scan_diff_document", """
SELECT CAST(0 AS INTEGER) AS pos, 'MISSING_IN_FILE_1' AS type, CAST(o_orderkey AS VARCHAR) AS id FROM orders
UNION ALL SELECT 1, 'FIELD_MISMATCH', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P'""")
def scan_diff_document(spark, sf_dir):
    def diff(kind, key):
        return F.struct(F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"))

    first, second = diff("MISSING_IN_FILE_1", "o_orderkey"), diff("FIELD_MISMATCH", "o_custkey")
    documents = t.table(spark, sf_dir, "orders").select(
        F.struct(F.col("o_orderkey").alias("run")).alias("metadata"),
        F.when(F.col("o_orderstatus") == "P", F.array(first)).otherwise(F.array(first, second)).alias("differences"),
    )
    path = scratch_path(spark, "documents")
    documents.write.json(path)
    return results.diffs_with_position(spark.read.json(path)).select("pos", "type", "id")


@query("newest_file_per_side", """
WITH l AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'FILE_1' ELSE 'FILE_2' END AS side, 'f' || o_orderkey || '.csv' AS name,
                  o_orderdate AS mtime, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT side, name, mtime FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY mtime DESC, name DESC) AS r
  FROM l WHERE o_orderpriority <> '1-URGENT') WHERE r = 1""")
def newest_file_per_side(spark, sf_dir):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "archive").otherwise(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    )
    listing = t.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "FILE_1").otherwise("FILE_2").alias("side"),
        F.concat(F.lit("/drop/"), name).alias("path"), name.alias("name"), F.col("o_orderdate").alias("mtime"),
        F.lit(True).alias("is_file"), (F.col("o_orderpriority") == "5-LOW").alias("is_directory"),
    )
    return files.newest_file_per_side(listing, archive_folder="archive").select("side", "name", "mtime")


# --- records -----------------------------------------------------------------


def _documents(spark, sf_dir):
    """One document per order with zero to two entries below data.orders.edges."""
    def node(kind, key):
        return F.struct(F.struct(
            F.concat(F.lit(f"gid://shopify/{kind}/"), F.col(key).cast("string")).alias("id"),
            F.col("o_orderstatus").alias("status"),
        ).alias("node"))

    order, customer = node("Order", "o_orderkey"), node("Customer", "o_custkey")
    priority = F.col("o_orderpriority")
    edges = (
        F.when(priority == "5-LOW", F.array_remove(F.array(order), order))
        .when(priority == "1-URGENT", F.array(order, customer))
        .when(priority != "2-HIGH", F.array(order))
    )
    return t.table(spark, sf_dir, "orders").select(
        F.struct(F.struct(edges.alias("edges")).alias("orders")).alias("data")
    )


_EDGES_SQL = """WITH e AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS compare_id, 'gid://shopify/Order/' || o_orderkey AS id, o_orderstatus AS status
  FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH')
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'gid://shopify/Customer/' || o_custkey, o_orderstatus
  FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("explode_records", f"{_EDGES_SQL} SELECT id, status FROM e")
def explode_records(spark, sf_dir):
    return records.explode_records(_documents(spark, sf_dir), "data.orders.edges").select("record.node.*")


NODE_SPEC = parse_id_spec("$.data.orders.edges[0].node.id|SHOPIFY_GID_TAIL", "JSON")


@query("extract_ids", f"{_EDGES_SQL} SELECT DISTINCT compare_id FROM e")
def extract_ids(spark, sf_dir):
    return records.extract_ids(_documents(spark, sf_dir), NODE_SPEC)


@query("extract_data", _EDGES_SQL + """
SELECT compare_id, CAST(to_json({'node': {'id': id, 'status': status}}) AS VARCHAR) AS data FROM e""")
def extract_data(spark, sf_dir):
    return records.extract_data(_documents(spark, sf_dir), NODE_SPEC).select(
        "compare_id", F.to_json("data").alias("data")
    )


# --- sinks -------------------------------------------------------------------


@query("write_diffs", f"{t.SIDES_SQL}, m AS ({MISSING_SQL}) SELECT *, count(*) OVER () AS written FROM m")
def write_diffs(spark, sf_dir):
    target = sinks.write_diffs(
        missing_diff_rows(spark, sf_dir), scratch_path(spark, "diffs"), {"file1Label": "Web"}, {"kind": "presence"}
    )
    summary, rows = results.scan_diffs(spark, target)
    written = json.loads(summary.first()["summary"])["writtenRows"]
    return rows.drop("pos").withColumn("written", F.lit(written).cast("bigint"))


@query("write_diff_csv", f"""{t.SIDES_SQL}, m AS ({MISSING_SQL})
SELECT type AS "diffType", id AS "primaryId", CAST(NULL AS VARCHAR) AS field, "presentIn", "missingIn", note AS message, data FROM m""")
def write_diff_csv(spark, sf_dir):
    target = sinks.write_diff_csv(to_ruleset_diff(spark, sf_dir), scratch_path(spark, "diffcsv"))
    return spark.read.csv(target, header=True, escape='"').select(
        "diffType", "primaryId", "field", "presentIn", "missingIn", "message", "data"
    )


# --- streams -----------------------------------------------------------------


@query("stream_poll_reconcile", f"""{t.SIDES_SQL}
SELECT 'MISSING_IN_FILE_2' AS type, a.compare_id AS id, 'Web' AS "presentIn", {t.JSON_A} AS data {ONLY_A}
UNION ALL SELECT 'MISSING_IN_FILE_1', b.compare_id, 'Back Office', {t.JSON_B} {ONLY_B}""")
def stream_poll_reconcile(spark, sf_dir):
    return _polled(spark, sf_dir).select("type", "id", "presentIn", "data")


def _polled(spark, sf_dir, scope=None):
    """Three polls: half of one side, its other half, then the second side; nothing may be lost on the way."""
    folders = [scratch_path(spark, "drop1"), scratch_path(spark, "drop2")]
    schema = "id string, custkey bigint, status string, price string"
    out, checkpoint = scratch_path(spark, "polled"), scratch_path(spark, "poll-checkpoint")
    first, second = (export(spark, sf_dir).select(*t.PAYLOAD) for export in (t.export_a, t.export_b))
    spark.createDataFrame([], schema).write.json(folders[1])
    odd = F.coalesce(F.col("custkey") % 2 == 1, F.lit(False))
    for rows, folder in ((first.filter(odd), folders[0]), (first.filter(~odd), folders[0]), (second, folders[1])):
        rows.write.mode("append").json(folder)
        streams = [polling.drop_stream(spark, f, "json", schema) for f in folders]
        polling.stream_poll_reconcile(
            *streams, SideConfig("id|SHOPIFY_GID_TAIL", "CSV", label="Web"), SideConfig("id", "CSV", label="Back Office"),
            out, checkpoint, "CSV", "CSV", scope=scope,
        ).awaitTermination()
    return spark.read.json(f"{out}/differences")


@query("stream_poll_ruleset", f"""{t.SIDES_SQL}, missing AS ({MISSING_SQL})
{RULESET_MISSING_SQL} UNION ALL {RULE_ROWS_SQL}""")
def stream_poll_ruleset(spark, sf_dir):
    return _polled(spark, sf_dir, t.scope(t.STATUS_RULE, t.PRICE_RULE)).select(*RULESET_DIFF_COLUMNS)


@query("stream_idempotent_windows", f"""WITH {t.EXECUTIONS_SQL}
SELECT DISTINCT automationId, scheduledDate, childWindowStart, childWindowEnd FROM executions""")
def stream_idempotent_windows(spark, sf_dir):
    """Five batches in no order of time, each window again in a later one."""
    source, target = scratch_path(spark, "submitted"), scratch_path(spark, "accepted")
    submitted = t.executions(spark, sf_dir)
    submitted.unionByName(submitted).repartition(5).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    polling.stream_idempotent_windows(stream, target, scratch_path(spark, "dedup-checkpoint")).awaitTermination()
    return spark.read.parquet(target).select(*polling.WINDOW_KEYS)
