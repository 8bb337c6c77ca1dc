"""Run results, executions, stored differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from twinledger.checks import tables as t
from twinledger.checks.comparing import MISSING_SQL, missing_diff_rows
from twinledger.checks.registry import query
from twinledger.operators import history as H
from twinledger.session import scratch_path


@query("tenant_filter", f"WITH {t.RESULTS_SQL} SELECT reconciliationRunResultId FROM results WHERE companyUserGroupId = '2-HIGH'")
def tenant_filter(spark, sf_dir):
    return H.tenant_filter(t.run_results(spark, sf_dir), "2-HIGH").select("reconciliationRunResultId")


@query("status_counts", f"""WITH {t.EXECUTIONS_SQL}
SELECT automationId, count(*) FILTER (statusEnumId = 'AUT_STAT_SUCCESS') AS "executedCount",
       count(*) FILTER (statusEnumId = 'AUT_STAT_NO_DATA') AS "noDataCount",
       count(*) FILTER (statusEnumId = 'AUT_STAT_FAILED') AS "failedCount",
       count(*) FILTER (statusEnumId = 'AUT_STAT_SKIP_DUP') AS "skippedDuplicateCount" FROM executions GROUP BY automationId""")
def status_counts(spark, sf_dir):
    return H.status_counts(t.executions(spark, sf_dir))


@query("execution_history_enrich", f"""WITH {t.EXECUTIONS_SQL}, {t.RESULTS_SQL}
SELECT automationExecutionId, reconciliationRunResultId,
       COALESCE(e.resultDataManagerPath, r.resultDataManagerPath) AS "resultDataManagerPath",
       COALESCE(e.resultFileName, regexp_extract(r.resultDataManagerPath, '([^/]+)$', 1)) AS "resultFileName"
FROM executions e LEFT JOIN results r USING (reconciliationRunResultId)""")
def execution_history_enrich(spark, sf_dir):
    return H.execution_history_enrich(t.executions(spark, sf_dir), t.run_results(spark, sf_dir)).select(
        "automationExecutionId", "reconciliationRunResultId", "resultDataManagerPath", "resultFileName"
    )


@query("collapse_execution_history", f"""WITH {t.EXECUTIONS_SQL}
SELECT automationExecutionId, automationId, childWindowStart FROM (
  SELECT *, row_number() OVER (PARTITION BY automationId, childWindowStart, childWindowEnd
                               ORDER BY scheduledDate DESC, automationExecutionId) AS r FROM executions)
WHERE r = 1 OR childWindowStart IS NULL""")
def collapse_execution_history(spark, sf_dir):
    executions = t.executions(spark, sf_dir)
    order = [-F.unix_micros(F.col("scheduledDate").cast("timestamp")), F.col("automationExecutionId")]
    return H.collapse_execution_history(executions, order).select(
        "automationExecutionId", "automationId", "childWindowStart"
    )


@query("last_run", f"""WITH {t.RESULTS_SQL}
SELECT createdByUserId, companyUserGroupId, reconciliationRunResultId, createdDate FROM (
  SELECT *, row_number() OVER (PARTITION BY createdByUserId, companyUserGroupId
                               ORDER BY createdDate DESC, reconciliationRunResultId DESC) AS r FROM results) WHERE r = 1""")
def last_run(spark, sf_dir):
    return H.last_run(t.run_results(spark, sf_dir)).select(
        "createdByUserId", "companyUserGroupId", "reconciliationRunResultId", "createdDate"
    )


@query("result_lookup", f"""WITH {t.RESULTS_SQL}, c AS (
  SELECT resultDataManagerPath AS path, 0 AS p, 'resultDataManagerPath' AS f, reconciliationRunResultId AS id FROM results
  UNION ALL SELECT file1DataManagerPath, 1, 'file1DataManagerPath', reconciliationRunResultId FROM results
  UNION ALL SELECT file2DataManagerPath, 2, 'file2DataManagerPath', reconciliationRunResultId FROM results),
w AS (SELECT 'in/' || c_custkey || '.csv' AS path FROM customer UNION ALL SELECT DISTINCT 'in/' || o_orderstatus || '.csv' FROM orders
      UNION ALL SELECT 'out/' || o_custkey || '/' || o_orderkey || '.json' FROM orders)
SELECT path, id AS "reconciliationRunResultId", f AS "matchedField" FROM (
  SELECT w.path, c.id, c.f, row_number() OVER (PARTITION BY w.path ORDER BY c.p, c.id) AS r FROM w JOIN c USING (path)) WHERE r = 1""")
def result_lookup(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    cust = F.col("c_custkey").cast("string")
    wanted = (
        t.table(spark, sf_dir, "customer").select(F.concat(F.lit("in/"), cust, F.lit(".csv")).alias("path"))
        .union(o.select(F.concat(F.lit("in/"), "o_orderstatus", F.lit(".csv"))).distinct())
        .union(o.select(F.concat(
            F.lit("out/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"),
            F.lit(".json"))))
    )
    return H.result_lookup(wanted, t.run_results(spark, sf_dir))


def _manifest_events(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_shipdate").alias("lastUpdatedDate"), F.min("l_returnflag").alias("flag"),
        F.count(F.lit(1)).alias("n"),
    ).select(
        F.concat(F.lit("R"), F.col("l_orderkey").cast("string")).alias("reconciliationRunResultId"),
        F.when(F.col("flag") == "A", "AUT_STAT_SUCCESS").when(F.col("flag") == "N", "AUT_STAT_RUNNING").alias("statusEnumId"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("n")).alias("differenceCount"),
        "lastUpdatedDate", F.col("l_linenumber").alias("seq"),
    )


@query("run_manifest", """WITH g AS (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS d, min(l_returnflag) AS flag, count(*) AS n
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT 'R' || l_orderkey AS id, CASE flag WHEN 'A' THEN 'AUT_STAT_SUCCESS' WHEN 'N' THEN 'AUT_STAT_RUNNING' END AS st,
             CASE WHEN l_linenumber % 2 = 0 THEN n END AS dc, d, l_linenumber AS seq FROM g)
SELECT id AS "reconciliationRunResultId",
       arg_max(st, (d, seq)) FILTER (st IS NOT NULL) AS "statusEnumId",
       CAST(arg_max(dc, (d, seq)) FILTER (dc IS NOT NULL) AS VARCHAR) AS "differenceCount", max(d) AS "lastUpdatedDate"
FROM e GROUP BY id""")
def run_manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    events = _manifest_events(spark, sf_dir)
    H.append_manifest(events.filter("seq <= 3"), path)
    H.append_manifest(events.filter("seq > 3"), path)
    latest = H.latest_manifest(spark.read.parquet(path), order=("lastUpdatedDate", "seq"))
    return latest.select("reconciliationRunResultId", "statusEnumId", F.col("differenceCount").cast("string").alias("differenceCount"), "lastUpdatedDate")


@query("filter_results", f"""WITH {t.RESULTS_SQL}
SELECT reconciliationRunResultId FROM results
WHERE COALESCE(savedRunId, reconciliationMappingId) = 'MAP7' OR (COALESCE(savedRunId, reconciliationMappingId) = 'RUN7')
  AND (contains(lower(savedRunName), 'urgent') OR contains(lower(statusEnumId), 'urgent'))
UNION ALL
SELECT reconciliationRunResultId FROM results WHERE contains(lower(savedRunName), 'urgent') OR contains(lower(statusEnumId), 'urgent')""")
def filter_results(spark, sf_dir):
    results = t.run_results(spark, sf_dir)
    found = (
        H.filter_results(results, "MAP7").union(H.filter_results(results, "RUN7", "Urgent"))
        .union(H.filter_results(results, None, " URGENT "))
    )
    return found.select("reconciliationRunResultId")


@query("list_results", f"""WITH {t.RESULTS_SQL}, f AS (SELECT * FROM results WHERE companyUserGroupId = '3-MEDIUM' AND contains(lower(savedRunName), 'night'))
SELECT reconciliationRunResultId, createdDate,
       CASE WHEN statusEnumId = 'AUT_STAT_RUNNING' THEN strftime(createdDate, '%Y-%m-%dT%H:%M:%SZ') ELSE 'day one' END AS "rangeStart",
       strftime(createdDate, '%Y-%m-%d') AS "rangeEnd", (SELECT count(*) FROM f) AS total
FROM f ORDER BY createdDate DESC, reconciliationRunResultId LIMIT 25 OFFSET 50""")
def list_results(spark, sf_dir):
    running = F.col("statusEnumId") == "AUT_STAT_RUNNING"
    metadata = F.to_json(F.struct(
        F.when(running, "").otherwise("day one").alias("windowStart"),
        F.when(running, F.unix_millis(F.col("createdDate").cast("timestamp"))).alias("windowStartEpochMillis"),
        F.date_format("createdDate", "yyyy-MM-dd").alias("dateTo"),
    ))
    results = t.run_results(spark, sf_dir).withColumn("metadata", metadata)
    page, numbers = H.list_results(results, "3-MEDIUM", query="Night", page=2, size=25, metadata_col="metadata")
    return page.select(
        "reconciliationRunResultId", "createdDate", "rangeStart", "rangeEnd",
        F.lit(numbers["totalCount"]).cast("bigint").alias("total"),
    )


@query("saved_run_catalog", """
WITH s AS (SELECT 'M' || c_custkey AS "savedRunId", c_name AS "runName", 'mapping' AS "runType",
                  [c_mktsegment, 'n' || c_nationkey] AS labels FROM customer
  UNION ALL SELECT 'S' || s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END, 'ruleset', ['OMS', 'Shopify'] FROM supplier)
SELECT "savedRunId", "runName", "runType" FROM s
WHERE contains(lower(concat_ws(' ', "savedRunId", "runName", "runType")), 'shop') OR contains(lower(array_to_string(labels, ' ')), 'shop')
   OR contains(lower(array_to_string(labels, ' ')), 'building') AND FALSE""")
def saved_run_catalog(spark, sf_dir):
    mappings = t.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("savedRunId"), F.col("c_name").alias("runName"),
        F.lit("mapping").alias("runType"),
        F.array(F.col("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("systemLabels"),
    )
    rule_sets = t.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("savedRunId"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("runName"), F.lit("ruleset").alias("runType"),
        F.array(F.lit("OMS"), F.lit("Shopify")).alias("systemLabels"),
    )
    return H.saved_run_catalog(mappings, rule_sets, "SHOP").select("savedRunId", "runName", "runType")


# --- stored differences ------------------------------------------------------


@query("search_diffs", f"""{t.SIDES_SQL}, m AS ({MISSING_SQL})
SELECT type, id FROM m WHERE id LIKE '%12%' AND (lower(type) = 'missing_in_file_2' OR lower("missingIn") = 'web')
UNION ALL SELECT type, id FROM m WHERE id LIKE '1%7'""")
def search_diffs(spark, sf_dir):
    diffs = missing_diff_rows(spark, sf_dir)
    found = H.search_diffs(diffs, "12", "missing_in_FILE_2", "WEB").union(H.search_diffs(diffs, "1%7"))
    return found.select("type", "id")


@query("paged_search", """
WITH f AS (SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS type FROM orders
           WHERE CAST(o_orderkey AS VARCHAR) LIKE '%3%'),
n AS (SELECT *, row_number() OVER (ORDER BY pos) AS r, count(*) OVER () AS total FROM f)
SELECT pos, id, type, total FROM n WHERE r > 60 AND r <= 80
UNION ALL SELECT pos, id, type, total FROM n WHERE r <= 20""")
def paged_search(spark, sf_dir):
    diffs = t.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("type")
    )
    found = H.search_diffs(diffs, "3")
    pages = [H.paged_search(found, index) for index in (3, 1_000_000_000)]
    first, second = (p.withColumn("total", F.lit(n["total"]).cast("bigint")) for p, n in pages)
    return first.union(second)


@query("retention_partition", """
WITH l AS (SELECT 'out/' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN '.JSON' WHEN 'O' THEN '.csv' ELSE '.txt' END AS name,
                  o_orderdate AS mtime FROM orders)
SELECT name, CASE WHEN mtime > TIMESTAMP '2000-01-16 00:00:00' THEN 'RETAIN' ELSE 'DELETE' END AS action
FROM l WHERE lower(name) LIKE '%.csv' OR lower(name) LIKE '%.json'""")
def retention_partition(spark, sf_dir):
    extension = F.when(F.col("o_orderstatus") == "F", ".JSON").when(F.col("o_orderstatus") == "O", ".csv").otherwise(".txt")
    listing = t.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("out/"), F.col("o_orderkey").cast("string"), extension).alias("name"),
        F.col("o_orderdate").alias("mtime"),
    )
    return H.retention_partition(listing, datetime(2000, 1, 31)).select("name", "action")


@query("retention_counts", """
SELECT count(*) AS "scannedCount", count(*) FILTER (o_orderdate <= TIMESTAMP '2000-01-16') AS "deletedCount",
       count(*) FILTER (o_orderdate > TIMESTAMP '2000-01-16') AS "retainedCount" FROM orders WHERE o_orderstatus <> 'P'""")
def retention_counts(spark, sf_dir):
    return H.retention_counts(retention_partition(spark, sf_dir))
