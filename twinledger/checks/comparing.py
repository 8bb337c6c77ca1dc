"""Presence, pairs, duplicates, unions and whole reconciliations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from twinledger.checks import tables as t
from twinledger.checks.registry import query
from twinledger.model import ConfigError, MappingMember
from twinledger.operators import compare as C
from twinledger.plans import reconcile as P

ONLY_A = "FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.compare_id = a.compare_id)"
ONLY_B = "FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.compare_id = b.compare_id)"

MISSING_SQL = f"""
  SELECT 'MISSING_IN_FILE_2' AS type, a.compare_id AS id, 'Web' AS "presentIn", 'Back Office' AS "missingIn",
         {t.JSON_A} AS data, 'Present in Web, missing in Back Office' AS note {ONLY_A}
  UNION ALL
  SELECT 'MISSING_IN_FILE_1', b.compare_id, 'Back Office', 'Web', {t.JSON_B},
         'Present in Back Office, missing in Web' {ONLY_B}"""

RULESET_MISSING_SQL = """
  SELECT type AS "diffType", 'ORDERS' AS "compareScopeId", 'ORDER' AS "objectType", id AS "primaryId",
         CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS "file1Value", CAST(NULL AS VARCHAR) AS "file2Value",
         "presentIn", "missingIn", data, CAST(NULL AS VARCHAR) AS "ruleId", CAST(NULL AS VARCHAR) AS severity,
         note AS message FROM missing"""

RULE_ROWS_SQL = """
  SELECT 'FIELD_MISMATCH' AS "diffType", 'ORDERS' AS "compareScopeId", 'ORDER' AS "objectType",
         a.compare_id AS "primaryId", 'status' AS field, a.status AS "file1Value", b.status AS "file2Value",
         CAST(NULL AS VARCHAR) AS "presentIn", CAST(NULL AS VARCHAR) AS "missingIn", CAST(NULL AS VARCHAR) AS data,
         'STATUS' AS "ruleId", 'WARN' AS severity, 'Status mismatch' AS message
  FROM a JOIN b USING (compare_id) WHERE a.status <> b.status
  UNION ALL
  SELECT 'FIELD_MISMATCH', 'ORDERS', 'ORDER', a.compare_id, 'price', a.price, b.price, NULL, NULL, NULL,
         'PRICE', 'ERROR', 'price differs between file 1 and file 2'
  FROM a JOIN b USING (compare_id) WHERE CAST(a.price AS DECIMAL(15,2)) <> CAST(b.price AS DECIMAL(15,2))"""


@query("only_in_left", f"{t.SIDES_SQL} SELECT compare_id {ONLY_A}")
def only_in_left(spark, sf_dir):
    return C.only_in_left(*t.id_sides(spark, sf_dir))


@query("only_in_right", f"{t.SIDES_SQL} SELECT compare_id {ONLY_B}")
def only_in_right(spark, sf_dir):
    return C.only_in_right(*t.id_sides(spark, sf_dir))


@query("matched_ids", f"{t.SIDES_SQL} SELECT compare_id FROM a WHERE compare_id IN (SELECT compare_id FROM b)")
def matched_ids(spark, sf_dir):
    return C.matched_ids(*t.id_sides(spark, sf_dir))


@query("reconcile_ids", f"""{t.SIDES_SQL}
SELECT 'left' AS side, compare_id {ONLY_A} UNION ALL SELECT 'right', compare_id {ONLY_B}""")
def reconcile_ids(spark, sf_dir):
    only = P.reconcile_ids(*t.id_sides(spark, sf_dir)).diffs
    return only["left"].select(F.lit("left").alias("side"), "compare_id").union(
        only["right"].select(F.lit("right").alias("side"), "compare_id")
    )


@query("missing_diff_rows", f"{t.SIDES_SQL} {MISSING_SQL}")
def missing_diff_rows(spark, sf_dir):
    a, b = t.sides(spark, sf_dir)
    ids = C.presence(a.select("compare_id"), b.select("compare_id"))
    return C.missing_on_both_sides(a, b, ids, "Web", "Back Office")


@query("union_missing", f"""{t.SIDES_SQL}, missing AS ({MISSING_SQL})
SELECT type, "presentIn", count(*) AS n, count(DISTINCT id) AS ids FROM missing GROUP BY ALL""")
def union_missing(spark, sf_dir):
    a, b = t.sides(spark, sf_dir)
    ids = C.presence(a.select("compare_id"), b.select("compare_id"))
    only1, only2 = ids.filter("n_left > 0 AND n_right = 0"), ids.filter("n_right > 0 AND n_left = 0")
    hot = C.hot_ids(ids)
    rows = C.union_missing(
        C.missing_diff_rows(a, only1, "MISSING_IN_FILE_2", "Web", "Back Office", hot),
        C.missing_diff_rows(b, only2, "MISSING_IN_FILE_1", "Back Office", "Web", hot),
    )
    return rows.groupBy("type", "presentIn").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")
    )


@query("to_ruleset_diff", f"{t.SIDES_SQL}, missing AS ({MISSING_SQL}) {RULESET_MISSING_SQL}")
def to_ruleset_diff(spark, sf_dir):
    return C.to_ruleset_diff(missing_diff_rows(spark, sf_dir), "ORDERS", "ORDER")


@query("matched_pairs", f"""{t.SIDES_SQL}
SELECT 'ORDERS' AS "compareScopeId", 'ORDER' AS "objectType", a.compare_id AS "primaryId",
       a.price AS price1, b.price AS price2 FROM a JOIN b USING (compare_id)""")
def matched_pairs(spark, sf_dir):
    pairs = C.matched_pairs(*t.sides(spark, sf_dir), "ORDERS", "ORDER")
    return pairs.select(
        "compareScopeId", "objectType", "primaryId",
        F.col("file1.price").alias("price1"), F.col("file2.price").alias("price2"),
    )


@query("full_outer_classify", f"""{t.SIDES_SQL}
SELECT COALESCE(a.compare_id, b.compare_id) AS "primaryId",
       CASE WHEN a.compare_id IS NULL THEN 'MISSING_IN_FILE_1' WHEN b.compare_id IS NULL THEN 'MISSING_IN_FILE_2'
            WHEN a.status <> b.status OR a.price <> b.price THEN 'MISMATCH' ELSE 'MATCH' END AS status
FROM a FULL JOIN b ON a.compare_id = b.compare_id""")
def full_outer_classify(spark, sf_dir):
    return C.full_outer_classify(*t.sides(spark, sf_dir), ["status", "price"])


@query("diff_summary", f"""{t.LINES_SQL},
p AS (SELECT compare_id, sum(l) AS n_left, sum(r) AS n_right FROM (
        SELECT compare_id, 1 AS l, 0 AS r FROM a UNION ALL SELECT compare_id, 0, 1 FROM b) GROUP BY compare_id)
SELECT CAST(count(*) FILTER (n_left > 0 AND n_right = 0) AS BIGINT) AS only_in_file1,
       CAST(count(*) FILTER (n_right > 0 AND n_left = 0) AS BIGINT) AS only_in_file2,
       CAST(count(*) FILTER (n_left = 0 OR n_right = 0) AS BIGINT) AS missing_total,
       CAST(count(*) FILTER (n_left > 0 AND n_right > 0) AS BIGINT) AS matched,
       CAST(sum(CASE WHEN n_left = 0 THEN n_right WHEN n_right = 0 THEN n_left END) AS BIGINT) AS missing_rows,
       CAST(count(*) FILTER (n_left > 1) AS BIGINT) AS duplicated_in_file1,
       CAST(count(*) FILTER (n_right > 1) AS BIGINT) AS duplicated_in_file2 FROM p""")
def diff_summary(spark, sf_dir):
    a, b = t.line_sides(spark, sf_dir)
    return C.diff_summary(C.presence(a.select("compare_id"), b.select("compare_id"))).drop("missing_bytes")


@query("find_duplicate_ids", f"""{t.LINES_SQL}
SELECT compare_id, count(*) AS row_count FROM a GROUP BY compare_id HAVING count(*) > 1
ORDER BY compare_id LIMIT 5""")
def find_duplicate_ids(spark, sf_dir):
    return C.find_duplicate_ids(t.line_sides(spark, sf_dir)[0])


@query("validate_unique_ids", f"""{t.LINES_SQL},
d AS (SELECT compare_id, count(*) AS n FROM a GROUP BY compare_id HAVING count(*) > 1 ORDER BY compare_id LIMIT 5)
SELECT 'Compare scope ''Lines'' FILE_1 (Web) produced duplicate primaryId values after normalization: '
       || string_agg(compare_id || ' (' || n || ' rows)', ', ' ORDER BY compare_id)
       || '. primaryId must identify exactly one object per file side.' AS problem FROM d""")
def validate_unique_ids(spark, sf_dir):
    data, _ = t.line_sides(spark, sf_dir)
    problems = []
    try:
        C.validate_unique_ids(data, "Lines", "FILE_1", "Web")
    except ConfigError as problem:
        problems.append((str(problem),))
    return spark.createDataFrame(problems, "problem string")


@query("collapse_duplicates", f"""{t.LINES_SQL}
SELECT compare_id, min({t.LINE_JSON_A}) AS data FROM a GROUP BY compare_id""")
def collapse_duplicates(spark, sf_dir):
    data, _ = t.line_sides(spark, sf_dir)
    return C.collapse_duplicates(data).select("compare_id", F.to_json("data").alias("data"))


@query("union_diffs", f"""{t.SIDES_SQL}, missing AS ({MISSING_SQL}), every AS ({RULESET_MISSING_SQL} UNION ALL {RULE_ROWS_SQL})
SELECT "diffType", field, "ruleId", count(*) AS n FROM every GROUP BY ALL""")
def union_diffs(spark, sf_dir):
    from twinledger.operators.rules import execute_pair_rules

    pairs = C.matched_pairs(*t.sides(spark, sf_dir), "ORDERS", "ORDER")
    rows, _, _ = execute_pair_rules(pairs, [t.STATUS_RULE, t.PRICE_RULE])
    return C.union_diffs(to_ruleset_diff(spark, sf_dir), rows).groupBy("diffType", "field", "ruleId").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("detail_item_join", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem l
JOIN (SELECT p_brand, p_partkey FROM part) p ON l.l_partkey = p.p_partkey
WHERE l.l_partkey = 42 AND l.l_returnflag = 'A'
  AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2001-01-01'""")
def detail_item_join(spark, sf_dir):
    items = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    found = C.detail_item_join(
        t.table(spark, sf_dir, "lineitem"), items, "l_partkey", "l_returnflag", "l_shipdate",
        42, "A", datetime(1996, 1, 1), datetime(2001, 1, 1),
    )
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("classify_counts", """
WITH l AS (SELECT l_suppkey AS suppkey, l_returnflag AS flag FROM lineitem),
r AS (SELECT s_suppkey + 2 AS suppkey, 'A' AS flag, s_acctbal FROM supplier
      UNION ALL SELECT CASE WHEN l_linestatus = 'O' OR l_returnflag = 'N' THEN l_suppkey ELSE l_suppkey + 3 END, l_returnflag, 1.0 FROM lineitem),
e AS (SELECT s_suppkey AS suppkey, flag FROM supplier, (VALUES ('A'), ('N'), ('R'), ('X')) v(flag)),
u AS (SELECT suppkey, flag, 1 AS a, 0 AS b, FALSE AS failed FROM l
      UNION ALL SELECT suppkey, flag, 0, 1, s_acctbal < 0 FROM r UNION ALL SELECT suppkey, flag, 0, 0, FALSE FROM e),
c AS (SELECT suppkey, flag, CAST(sum(a) AS BIGINT) AS left_count, CAST(sum(b) AS BIGINT) AS right_count,
             bool_or(failed) AS failed FROM u GROUP BY suppkey, flag)
SELECT suppkey, flag, left_count, right_count,
       CASE WHEN failed THEN 'ERROR' WHEN left_count = 0 AND right_count = 0 THEN 'NO_RECORDS'
            WHEN left_count = 0 THEN 'MISSING_IN_NS' WHEN right_count = 0 THEN 'MISSING_IN_READ_DB'
            WHEN left_count <> right_count THEN 'COUNT_MISMATCH' ELSE 'MATCHED_COUNT' END AS compare_status
FROM c""")
def classify_counts(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem")
    left = lines.select(F.col("l_suppkey").alias("suppkey"), F.col("l_returnflag").alias("flag"))
    settled = (F.col("l_linestatus") != "O") & (F.col("l_returnflag") != "N")  # the other system books these under another supplier
    booked = lines.select(F.when(settled, F.col("l_suppkey") + 3).otherwise(F.col("l_suppkey")).alias("suppkey"),
                          F.col("l_returnflag").alias("flag"), F.lit(1.0).alias("s_acctbal"))
    suppliers = t.table(spark, sf_dir, "supplier")
    right = suppliers.select((F.col("s_suppkey") + 2).alias("suppkey"), F.lit("A").alias("flag"), "s_acctbal").unionByName(booked)
    expected = suppliers.select(F.col("s_suppkey").alias("suppkey"), F.explode(F.array(*map(F.lit, "ANRX"))).alias("flag"))
    return C.classify_counts(left, right, ["suppkey", "flag"], error_b=F.col("s_acctbal") < 0, expected=expected)


@query("reconcile_unified", f"""{t.LINES_SQL}
SELECT 'missing_in_BackOffice' AS type, a.compare_id AS id, 'Web' AS "presentIn", 'Back Office' AS "missingIn",
       {t.LINE_JSON_A} AS data, 'Present in Web, missing in Back Office' AS note {ONLY_A}
UNION ALL
SELECT 'missing_in_Web', b.compare_id, 'Back Office', 'Web', {t.LINE_JSON_B},
       'Present in Back Office, missing in Web' {ONLY_B}""")
def reconcile_unified(spark, sf_dir):
    return P.reconcile_unified(*t.line_sides(spark, sf_dir), "Web", "Back Office").diffs


@query("reconcile_by_mapping", f"""{t.SIDES_SQL}
SELECT 'missing_in_NETSUITE' AS type, a.compare_id AS id, 'SHOPIFY' AS "presentIn", 'NETSUITE' AS "missingIn",
       'Present in SHOPIFY, missing in NETSUITE' AS note {ONLY_A}
UNION ALL
SELECT 'missing_in_SHOPIFY', b.compare_id, 'NETSUITE', 'SHOPIFY', 'Present in NETSUITE, missing in SHOPIFY' {ONLY_B}""")
def reconcile_by_mapping(spark, sf_dir):
    members = [MappingMember("SHOPIFY", "$.id|shopify-gid-tail", "JSON"), MappingMember("NETSUITE", "id", "CSV")]
    result = P.reconcile_by_mapping(
        "MAP1", members, t.export_a(spark, sf_dir), t.export_b(spark, sf_dir), "SHOPIFY", "NETSUITE"
    )
    return result.diffs.drop("data")


@query("base_diff", f"{t.SIDES_SQL} {MISSING_SQL}")
def base_diff(spark, sf_dir):
    return P.base_diff(*t.sides(spark, sf_dir), t.scope()).diffs


@query("reconcile_ruleset", f"""{t.SIDES_SQL}, missing AS ({MISSING_SQL})
{RULESET_MISSING_SQL} UNION ALL {RULE_ROWS_SQL}""")
def reconcile_ruleset(spark, sf_dir):
    return P.reconcile_ruleset(*t.sides(spark, sf_dir), t.scope(t.STATUS_RULE, t.PRICE_RULE), count=False).diffs


@query("reconcile_ruleset_one_join", f"""{t.SIDES_SQL}, missing AS ({MISSING_SQL})
{RULESET_MISSING_SQL} UNION ALL {RULE_ROWS_SQL}""")
def reconcile_ruleset_one_join(spark, sf_dir):
    """The way that many missing ids take; the same rows."""
    return P.reconcile_ruleset(*t.sides(spark, sf_dir), t.scope(t.STATUS_RULE, t.PRICE_RULE), count=False, picked=False).diffs


@query("reconcile_ruleset_summary", f"""{t.SIDES_SQL}, missing AS ({MISSING_SQL}), r AS ({RULE_ROWS_SQL})
SELECT (SELECT count(*) FROM missing WHERE type = 'MISSING_IN_FILE_1') AS "missingInFile1Count",
       (SELECT count(*) FROM missing WHERE type = 'MISSING_IN_FILE_2') AS "missingInFile2Count",
       (SELECT count(*) FROM missing) AS "missingObjectDifferenceCount",
       (SELECT count(*) FROM a JOIN b USING (compare_id)) AS "matchedPairCount", CAST(2 AS BIGINT) AS "ruleCount",
       (SELECT count(*) FROM r) AS "ruleDifferenceCount", (SELECT count(*) FROM r) AS "firedRuleCount",
       (SELECT count(*) FROM missing) + (SELECT count(*) FROM r) AS "differenceCount" """)
def reconcile_ruleset_summary(spark, sf_dir):
    summary = P.reconcile_ruleset(*t.sides(spark, sf_dir), t.scope(t.STATUS_RULE, t.PRICE_RULE)).summary
    return spark.createDataFrame([tuple(summary.values())], ", ".join(f"{k} bigint" for k in summary))


@query("reconcile_ruleset_without_rules", f"""{t.LINES_SQL}
SELECT 'MISSING_IN_FILE_2' AS "diffType", a.compare_id AS "primaryId", min({t.LINE_JSON_A}) AS data {ONLY_A}
GROUP BY a.compare_id
UNION ALL
SELECT 'MISSING_IN_FILE_1', b.compare_id, min({t.LINE_JSON_B}) {ONLY_B} GROUP BY b.compare_id""")
def reconcile_ruleset_without_rules(spark, sf_dir):
    return P.reconcile_ruleset(*t.line_sides(spark, sf_dir), t.scope()).diffs.select("diffType", "primaryId", "data")
