"""Two-sided inputs derived from whole tables, in Spark and in SQL.

Both sides hold every order.  The second system renumbers urgent orders, so
ids go missing both ways, and has its own status or price for some customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions.ids import parse_id_spec
from twinledger.model import CompareScope, Rule, SideConfig
from twinledger.operators.records import extract_data


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price(col):
    return col.cast("decimal(15,2)").cast("string")


def export_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("gid://shopify/Order/"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderstatus").alias("status"),
        _price(F.col("o_totalprice")).alias("price"),
        F.col("o_orderdate").alias("placed"),
    )


def export_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") + 1_000_000_000_000).otherwise(
        F.col("o_orderkey")
    )
    price = F.col("o_totalprice").cast("decimal(15,2)")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.col("o_custkey").alias("custkey"),
        F.when(F.col("o_custkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_custkey") % 13 == 0, price + 1).otherwise(price).cast("decimal(15,2)").cast("string")
        .alias("price"),
        F.col("o_orderdate").alias("placed"),
    )


PAYLOAD = ["id", "custkey", "status", "price"]
SPEC = parse_id_spec("id|SHOPIFY_GID_TAIL", "CSV")


def sides(spark: SparkSession, sf_dir: str, dated: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(compare_id, data)`` of both exports; ids are unique on each side."""
    keep = ("placed",) if dated else ()
    return tuple(
        extract_data(export(spark, sf_dir).select(*PAYLOAD, *keep), SPEC, keep=keep)
        for export in (export_a, export_b)
    )


def id_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = sides(spark, sf_dir)
    return a.select("compare_id"), b.select("compare_id")


def line_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines of two systems; line ids repeat on both sides."""
    lines = table(spark, sf_dir, "lineitem")
    plain = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    marked = F.when(F.col("l_returnflag") == "R", F.concat(plain, F.lit("-R"))).otherwise(plain)
    spec = parse_id_spec("line", "CSV")
    return tuple(
        extract_data(lines.select(key.alias("line"), "l_partkey", "l_suppkey", "l_returnflag"), spec)
        for key in (plain, marked)
    )


def scope(*rules: Rule) -> CompareScope:
    return CompareScope(
        "ORDERS", SideConfig("id", "CSV", label="Web", id_normalizer="SHOPIFY_GID_TAIL"),
        SideConfig("id", "CSV", label="Back Office"), object_type="ORDER", description="Order export",
        rule_set_id="RS_ORDERS", rules=rules,
    )


STATUS_RULE = Rule("STATUS", 10, "FIELD_COMPARISON", severity="WARN", message="Status mismatch",
                   expression={"file1FieldPath": "status", "file2FieldPath": "status", "operator": "="})
PRICE_RULE = Rule("PRICE", 20, "FIELD_COMPARISON", severity="ERROR",
                  expression={"file1FieldPath": "price", "file2FieldPath": "price", "operator": "=",
                              "preActions": ["STRING_TO_NUMBER"]})

A_SQL = """a AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS compare_id, 'gid://shopify/Order/' || o_orderkey AS id,
         o_custkey AS custkey, o_orderstatus AS status,
         CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price, o_orderdate AS placed
  FROM orders)"""
B_SQL = """b AS (
  SELECT CAST(k AS VARCHAR) AS compare_id, CAST(k AS VARCHAR) AS id, o_custkey AS custkey,
         CASE WHEN o_custkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS status,
         CAST(CAST(CASE WHEN o_custkey % 13 = 0 THEN p + 1 ELSE p END AS DECIMAL(15,2)) AS VARCHAR) AS price,
         o_orderdate AS placed
  FROM (SELECT *, CAST(o_totalprice AS DECIMAL(15,2)) AS p,
               CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey + 1000000000000 ELSE o_orderkey END AS k
        FROM orders))"""
SIDES_SQL = f"WITH {A_SQL}, {B_SQL}"
JSON_SQL = "CAST(to_json({{'id': {t}.id, 'custkey': {t}.custkey, 'status': {t}.status, 'price': {t}.price}}) AS VARCHAR)"
JSON_A, JSON_B = JSON_SQL.format(t="a"), JSON_SQL.format(t="b")
LINES_SQL = """WITH raw AS (
  SELECT l_orderkey || '-' || l_linenumber AS line, l_partkey, l_suppkey, l_returnflag FROM lineitem),
a AS (SELECT line AS compare_id, * FROM raw),
b AS (SELECT k AS compare_id, k AS line, l_partkey, l_suppkey, l_returnflag
      FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN line || '-R' ELSE line END AS k FROM raw))"""
LINE_JSON_SQL = ("CAST(to_json({{'line': {t}.line, 'l_partkey': {t}.l_partkey, 'l_suppkey': {t}.l_suppkey, "
                 "'l_returnflag': {t}.l_returnflag}}) AS VARCHAR)")
LINE_JSON_A, LINE_JSON_B = LINE_JSON_SQL.format(t="a"), LINE_JSON_SQL.format(t="b")


# --- run tables --------------------------------------------------------------


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One automation execution per order; low-priority ones have no window."""
    o = table(spark, sf_dir, "orders")
    windowed = F.col("o_orderpriority") != "5-LOW"
    month = F.date_trunc("month", "o_orderdate")
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "AUT_STAT_PENDING")
        .when(F.col("o_orderpriority") == "2-HIGH", "AUT_STAT_NO_DATA")
        .when(F.col("o_orderstatus") == "F", "AUT_STAT_SUCCESS")
        .when(F.col("o_orderstatus") == "O", "AUT_STAT_FAILED")
        .otherwise("AUT_STAT_SKIP_DUP")
    )
    return o.select(
        F.concat(F.lit("E"), F.col("o_orderkey")).alias("automationExecutionId"),
        F.concat(F.lit("AUTO"), F.col("o_custkey")).alias("automationId"),
        status.alias("statusEnumId"),
        F.col("o_orderdate").alias("scheduledDate"),
        F.when(windowed, month).alias("childWindowStart"),
        F.when(windowed, F.add_months(month, 1).cast("timestamp")).alias("childWindowEnd"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("own/"), F.col("o_orderkey"), F.lit(".json")))
        .alias("resultDataManagerPath"),
        F.when(F.col("o_orderstatus") == "P", F.lit("named.json")).alias("resultFileName"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.concat(F.lit("R"), F.col("o_orderkey")))
        .alias("reconciliationRunResultId"),
    )


EXECUTIONS_SQL = """executions AS (
  SELECT 'E' || o_orderkey AS automationExecutionId, 'AUTO' || o_custkey AS automationId,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'AUT_STAT_PENDING'
              WHEN o_orderpriority = '2-HIGH' THEN 'AUT_STAT_NO_DATA'
              WHEN o_orderstatus = 'F' THEN 'AUT_STAT_SUCCESS'
              WHEN o_orderstatus = 'O' THEN 'AUT_STAT_FAILED' ELSE 'AUT_STAT_SKIP_DUP' END AS statusEnumId,
         o_orderdate AS scheduledDate,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) END AS childWindowStart,
         CASE WHEN o_orderpriority <> '5-LOW'
              THEN CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP) END AS childWindowEnd,
         CASE WHEN o_orderstatus = 'F' THEN 'own/' || o_orderkey || '.json' END AS resultDataManagerPath,
         CASE WHEN o_orderstatus = 'P' THEN 'named.json' END AS resultFileName,
         CASE WHEN o_orderpriority <> '3-MEDIUM' THEN 'R' || o_orderkey END AS reconciliationRunResultId
  FROM orders)"""


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run result per order; customers share input files."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return o.select(
        F.concat(F.lit("R"), key).alias("reconciliationRunResultId"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("RUN"), cust)).alias("savedRunId"),
        F.concat(F.lit("MAP"), cust).alias("reconciliationMappingId"),
        F.concat(F.lit("Nightly "), F.col("o_orderpriority")).alias("savedRunName"),
        F.col("o_orderpriority").alias("companyUserGroupId"),
        F.concat(F.lit("U"), cust).alias("createdByUserId"),
        F.concat(F.lit("out/"), cust, F.lit("/"), key, F.lit(".json")).alias("resultDataManagerPath"),
        F.concat(F.lit("in/"), cust, F.lit(".csv")).alias("file1DataManagerPath"),
        F.concat(F.lit("in/"), F.col("o_orderstatus"), F.lit(".csv")).alias("file2DataManagerPath"),
        F.when(F.col("o_orderstatus") == "O", "AUT_STAT_RUNNING").otherwise("AUT_STAT_SUCCESS").alias("statusEnumId"),
        F.col("o_orderdate").alias("createdDate"),
    )


RESULTS_SQL = """results AS (
  SELECT 'R' || o_orderkey AS reconciliationRunResultId,
         CASE WHEN o_orderstatus <> 'P' THEN 'RUN' || o_custkey END AS savedRunId,
         'MAP' || o_custkey AS reconciliationMappingId, 'Nightly ' || o_orderpriority AS savedRunName,
         o_orderpriority AS companyUserGroupId, 'U' || o_custkey AS createdByUserId,
         'out/' || o_custkey || '/' || o_orderkey || '.json' AS resultDataManagerPath,
         'in/' || o_custkey || '.csv' AS file1DataManagerPath, 'in/' || o_orderstatus || '.csv' AS file2DataManagerPath,
         CASE WHEN o_orderstatus = 'O' THEN 'AUT_STAT_RUNNING' ELSE 'AUT_STAT_SUCCESS' END AS statusEnumId,
         o_orderdate AS createdDate
  FROM orders)"""
