"""Calendar windows, slicing, windowed comparison."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from twinledger.checks import tables as t
from twinledger.checks.registry import query
from twinledger.operators import windows as W
from twinledger.checks.comparing import MISSING_SQL, RULE_ROWS_SQL, RULESET_MISSING_SQL
from twinledger.plans.windowed import windowed_diffs, windowed_reconcile, windowed_ruleset, window_presence

ZONES = ["UTC", "America/Los_Angeles", "Asia/Kolkata", "Europe/Berlin", "Not/AZone"]
KINDS = ["AUT_WIN_PREV_DAY", "AUT_WIN_PREV_WEEK", "AUT_WIN_PREV_MONTH", "AUT_WIN_LAST_DAYS", "AUT_WIN_LAST_WEEKS",
         "AUT_WIN_LAST_MONTHS", "AUT_WIN_CUSTOM"]


def automations(spark, sf_dir):
    """One automation per customer; each fires at its own hour of two years."""
    key = F.col("c_custkey")

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    fire = F.timestamp_seconds(F.lit(1704067200) + key * 39_600)
    return t.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("AUTO"), key.cast("string")).alias("automationId"),
        F.when(F.col("c_mktsegment") == "BUILDING", "N").otherwise("y").alias("isActive"),
        pick(KINDS, key % 7).alias("relativeWindowTypeEnumId"),
        (F.col("c_nationkey") % 4).cast("int").alias("relativeWindowCount"),
        pick(ZONES, F.col("c_nationkey") % 5).alias("windowTimeZone"),
        F.when(key % 3 != 0, fire - F.expr("interval 100 days")).alias("customWindowStartDate"),
        F.when(key % 5 != 0, fire - F.expr("interval 90 minutes")).alias("customWindowEndDate"),
        fire.alias("fireTime"),
        F.when(F.col("c_nationkey") < 8, fire).alias("nextScheduledFireTime"),
        F.when(F.col("c_nationkey") < 20, fire - F.expr("interval 10 days")).alias("lastScheduledFireTime"),
        (F.col("c_nationkey") * 3600).cast("bigint").alias("scheduleSeconds"),
    )


AUTOMATIONS_SQL = """automations AS (
  SELECT 'AUTO' || c_custkey AS automationId, CASE WHEN c_mktsegment = 'BUILDING' THEN 'N' ELSE 'y' END AS active,
         ['AUT_WIN_PREV_DAY','AUT_WIN_PREV_WEEK','AUT_WIN_PREV_MONTH','AUT_WIN_LAST_DAYS','AUT_WIN_LAST_WEEKS',
          'AUT_WIN_LAST_MONTHS','AUT_WIN_CUSTOM'][c_custkey % 7 + 1] AS kind,
         greatest(c_nationkey % 4, 1) AS n,
         ['UTC','America/Los_Angeles','Asia/Kolkata','Europe/Berlin','UTC'][c_nationkey % 5 + 1] AS zone,
         CASE WHEN c_custkey % 3 <> 0 THEN fire - INTERVAL 100 DAY END AS cs,
         CASE WHEN c_custkey % 5 <> 0 THEN fire - INTERVAL 90 MINUTE END AS ce, fire,
         CASE WHEN c_nationkey < 8 THEN fire END AS next_fire, CASE WHEN c_nationkey < 20 THEN fire - INTERVAL 10 DAY END AS last_fire,
         CAST(c_nationkey * 3600 AS BIGINT) AS step
  FROM (SELECT *, TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 39600) AS fire FROM customer))"""
WINDOWS_SQL = AUTOMATIONS_SQL + """,
l AS (SELECT *, CAST(timezone(zone, timezone('UTC', fire)) AS DATE) AS d FROM automations),
w0 AS (SELECT *, CAST(date_trunc('week', d) AS DATE) AS wk, CAST(date_trunc('month', d) AS DATE) AS mo FROM l),
w1 AS (SELECT *, CASE kind WHEN 'AUT_WIN_PREV_DAY' THEN d - 1 WHEN 'AUT_WIN_PREV_WEEK' THEN wk - 7
                 WHEN 'AUT_WIN_PREV_MONTH' THEN CAST(mo - INTERVAL 1 MONTH AS DATE) WHEN 'AUT_WIN_LAST_WEEKS' THEN wk - CAST(n * 7 AS INTEGER)
                 WHEN 'AUT_WIN_LAST_MONTHS' THEN CAST(mo - to_months(CAST(n AS INTEGER)) AS DATE) ELSE d - CAST(n AS INTEGER) END AS sd,
                 CASE WHEN kind IN ('AUT_WIN_PREV_WEEK','AUT_WIN_LAST_WEEKS') THEN wk
                      WHEN kind IN ('AUT_WIN_PREV_MONTH','AUT_WIN_LAST_MONTHS') THEN mo ELSE d END AS ed FROM w0),
w AS (SELECT automationId, zone,
             CASE WHEN kind = 'AUT_WIN_CUSTOM' THEN cs ELSE timezone('UTC', timezone(zone, CAST(sd AS TIMESTAMP))) END AS ws,
             CASE WHEN kind = 'AUT_WIN_CUSTOM' THEN ce ELSE timezone('UTC', timezone(zone, CAST(ed AS TIMESTAMP))) END AS we FROM w1)"""


@query("resolve_windows", f"""WITH {WINDOWS_SQL}
SELECT automationId, zone, ws AS "windowStart", we AS "windowEnd",
       CASE WHEN ws IS NULL THEN 'windowStartDate is required for custom automation windows'
            WHEN we IS NULL THEN 'windowEndDate is required for custom automation windows'
            WHEN ws >= we THEN 'Automation window start must be before window end' END AS "windowError" FROM w""")
def resolve_windows(spark, sf_dir):
    return W.resolve_windows(automations(spark, sf_dir)).select(
        "automationId", "zone", "windowStart", "windowEnd", "windowError"
    )


@query("split_month_windows", f"""WITH {WINDOWS_SQL},
m AS (SELECT automationId, zone, ws, we, unnest(generate_series(
        date_trunc('month', timezone(zone, timezone('UTC', ws))), timezone(zone, timezone('UTC', we)), INTERVAL 1 MONTH)) AS mo
      FROM w WHERE ws < we),
s AS (SELECT automationId, greatest(ws, timezone('UTC', timezone(zone, CAST(mo AS TIMESTAMP)))) AS cs,
             least(we, timezone('UTC', timezone(zone, CAST(mo + INTERVAL 1 MONTH AS TIMESTAMP)))) AS ce FROM m)
SELECT automationId, CAST(row_number() OVER (PARTITION BY automationId ORDER BY cs) AS INTEGER) AS "sequenceNum",
       cs AS "childWindowStart", ce AS "childWindowEnd" FROM s WHERE cs < ce""")
def split_month_windows(spark, sf_dir):
    return W.split_month_windows(W.resolve_windows(automations(spark, sf_dir))).select(
        "automationId", "sequenceNum", "childWindowStart", "childWindowEnd"
    )


@query("calendar_window", """
WITH s AS (SELECT o_orderkey, ['UTC','America/Los_Angeles','Asia/Kolkata','Europe/Berlin','UTC'][o_custkey % 5 + 1] AS zone,
       CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 5 MINUTE ELSE o_orderdate END AS ws, o_orderdate + INTERVAL 3 DAY AS we,
       CASE WHEN o_orderpriority = '1-URGENT' THEN DATE '2026-03-01' END AS sd,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN DATE '2026-04-01' END AS ed FROM orders),
c AS (SELECT *, sd IS NOT NULL AND ed IS NOT NULL AS explicit, ws = date_trunc('day', ws) AND we = date_trunc('day', we) AS whole FROM s)
SELECT o_orderkey, zone, explicit OR whole AS "calendarDateNormalized",
  CASE WHEN explicit THEN timezone('UTC', timezone(zone, CAST(sd AS TIMESTAMP))) WHEN whole THEN timezone('UTC', timezone(zone, CAST(ws AS TIMESTAMP))) ELSE ws END AS "windowStart",
  CASE WHEN explicit THEN timezone('UTC', timezone(zone, CAST(ed AS TIMESTAMP))) WHEN whole THEN timezone('UTC', timezone(zone, CAST(we AS TIMESTAMP))) ELSE we END AS "windowEnd"
FROM c""")
def calendar_window(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    given = t.table(spark, sf_dir, "orders").select(
        "o_orderkey", zone.alias("windowTimeZone"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate") + F.expr("interval 5 minutes"))
        .otherwise(F.col("o_orderdate")).alias("windowStart"),
        (F.col("o_orderdate") + F.expr("interval 3 days")).alias("windowEnd"),
        F.when(urgent, "2026-03-01").alias("startDate"),
        F.when(urgent & (F.col("o_orderstatus") != "F"), "2026-04-01").alias("endDate"),
    )
    return W.calendar_window(given, start_date_col="startDate", end_date_col="endDate").select(
        "o_orderkey", "zone", "calendarDateNormalized", "windowStart", "windowEnd"
    )


@query("idempotent_windows", f"""WITH {t.EXECUTIONS_SQL},
d AS (SELECT automationId, scheduledDate, childWindowStart, childWindowEnd,
             bool_or(statusEnumId <> 'AUT_STAT_PENDING') AS finished FROM executions GROUP BY ALL),
c AS (SELECT 'AUTO' || o_custkey AS automationId, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS scheduledDate,
             CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS childWindowStart,
             CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP) AS childWindowEnd, o_orderkey FROM orders)
SELECT o_orderkey, CASE WHEN finished IS NULL THEN 'NEW' WHEN finished THEN 'AUT_STAT_SKIP_DUP' ELSE 'REUSED' END AS disposition
FROM c LEFT JOIN d USING (automationId, scheduledDate, childWindowStart, childWindowEnd)""")
def idempotent_windows(spark, sf_dir):
    month = F.date_trunc("month", "o_orderdate")
    candidates = t.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("AUTO"), F.col("o_custkey")).alias("automationId"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 1 day"))
        .otherwise(F.col("o_orderdate")).alias("scheduledDate"),
        month.alias("childWindowStart"), F.add_months(month, 1).cast("timestamp").alias("childWindowEnd"),
    )
    return W.idempotent_windows(candidates, t.executions(spark, sf_dir)).select("o_orderkey", "disposition")


@query("due_automations", f"""WITH {AUTOMATIONS_SQL}, f AS (SELECT automationId, COALESCE(
    CASE WHEN next_fire IS NOT NULL AND next_fire <= TIMESTAMP '2025-01-01' THEN next_fire END,
    CASE WHEN next_fire IS NULL AND step > 0 AND date_diff('second', last_fire, TIMESTAMP '2025-01-01') >= step
         THEN last_fire + to_seconds(CAST(floor(date_diff('second', last_fire, TIMESTAMP '2025-01-01') / step) AS BIGINT) * step) END) AS due
  FROM automations WHERE upper(active) = 'Y')
SELECT automationId, due AS "dueFireTime" FROM f WHERE due IS NOT NULL ORDER BY due, automationId LIMIT 100""")
def due_automations(spark, sf_dir):
    return W.due_automations(automations(spark, sf_dir), datetime(2025, 1, 1)).select("automationId", "dueFireTime")


SLICES_SQL = """
WITH RECURSIVE t AS (SELECT CAST(epoch_ms(ts) AS BIGINT) AS ms FROM events),
w AS (SELECT CAST(epoch_ms(TIMESTAMP '2024-01-01') AS BIGINT) AS s, CAST(epoch_ms(TIMESTAMP '2024-02-01') AS BIGINT) AS e
  UNION ALL
  SELECT CASE WHEN h = 0 THEN s ELSE s + (e - s) // 2 END, CASE WHEN h = 0 THEN s + (e - s) // 2 ELSE e END
  FROM (SELECT w.s, w.e FROM w JOIN t ON t.ms >= w.s AND t.ms < w.e GROUP BY w.s, w.e HAVING count(*) > 1000) x, (VALUES (0), (1)) v(h)),
c AS (SELECT w.s, w.e, count(t.ms) AS n FROM w LEFT JOIN t ON t.ms >= w.s AND t.ms < w.e GROUP BY w.s, w.e)
SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS "sequenceNum", make_timestamp(s * 1000) AS start, make_timestamp(e * 1000) AS "end",
       n AS "recordCount" FROM c WHERE n <= 1000"""


@query("adaptive_slices", SLICES_SQL)
def adaptive_slices(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    return W.adaptive_slices(events, "ts", datetime(2024, 1, 1), datetime(2024, 2, 1), 50).frame(spark)


@query("adaptive_slices_many", SLICES_SQL.replace("> 1000)", "> 4)").replace("n <= 1000", "n <= 4"))
def adaptive_slices_many(spark, sf_dir):
    """Far more slices than any source's own limit."""
    events = t.table(spark, sf_dir, "events")
    return W.adaptive_slices(events, "ts", datetime(2024, 1, 1), datetime(2024, 2, 1), 2, max_pages=2).frame(spark)


def _order_windows(spark, sf_dir):
    """Calendar months of the order history as windows, from the data itself."""
    bounds = t.table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    whole = bounds.select(
        (F.date_trunc("month", "s") - F.expr("interval 1 month")).alias("windowStart"),
        (F.date_trunc("month", "e") + F.expr("interval 2 month")).alias("windowEnd"), F.lit("UTC").alias("zone"),
    )
    return W.split_month_windows(whole).select(
        F.col("sequenceNum").alias("window_id"), F.col("childWindowStart").alias("start"), F.col("childWindowEnd").alias("end")
    )


_ORDER_WINDOWS_SQL = """w AS (SELECT CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS window_id, CAST(s AS TIMESTAMP) AS start,
   CAST(s + INTERVAL 1 MONTH AS TIMESTAMP) AS "end" FROM (SELECT unnest(generate_series(
     CAST(date_trunc('month', min(o_orderdate)) - INTERVAL 1 MONTH AS TIMESTAMP),
     CAST(date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH AS TIMESTAMP), INTERVAL 1 MONTH)) AS s FROM orders))"""
_TAGGED_SQL = f"""{t.SIDES_SQL}, {_ORDER_WINDOWS_SQL},
u AS (SELECT window_id, compare_id, 1 AS l, 0 AS r FROM a JOIN w ON placed >= start AND placed < "end"
      UNION ALL SELECT window_id, compare_id, 0, 1 FROM b JOIN w ON placed >= start AND placed < "end"),
p AS (SELECT window_id, compare_id, sum(l) AS n_left, sum(r) AS n_right FROM u GROUP BY ALL)"""


@query("windowed_reconcile", _TAGGED_SQL + """,
g AS (SELECT window_id, sum(n_left) AS f1, sum(n_right) AS f2, count(*) FILTER (n_right = 0) AS o1,
             count(*) FILTER (n_left = 0) AS o2, count(*) FILTER (n_left > 0 AND n_right > 0) AS m FROM p GROUP BY window_id)
SELECT window_id, start, "end", CASE WHEN f1 > 0 AND f2 > 0 THEN 'AUT_STAT_SUCCESS' ELSE 'AUT_STAT_NO_DATA' END AS "statusEnumId",
       CAST(COALESCE(f1, 0) AS BIGINT) AS file1_count, CAST(COALESCE(f2, 0) AS BIGINT) AS file2_count,
       CAST(CASE WHEN f1 > 0 AND f2 > 0 THEN o1 ELSE 0 END AS BIGINT) AS only_in_file1, CAST(CASE WHEN f1 > 0 AND f2 > 0 THEN o2 ELSE 0 END AS BIGINT) AS only_in_file2,
       CAST(COALESCE(m, 0) AS BIGINT) AS matched FROM w LEFT JOIN g USING (window_id)""")
def windowed(spark, sf_dir):
    a, b = t.sides(spark, sf_dir, dated=True)
    return windowed_reconcile(a, b, _order_windows(spark, sf_dir), "placed", "placed")


@query("windowed_diffs", _TAGGED_SQL + """
SELECT window_id, compare_id, CASE WHEN n_right = 0 THEN 'MISSING_IN_FILE_2' ELSE 'MISSING_IN_FILE_1' END AS "diffType"
FROM p WHERE (n_left = 0 OR n_right = 0) AND window_id IN (SELECT window_id FROM p GROUP BY window_id HAVING sum(n_left) > 0 AND sum(n_right) > 0)""")
def windowed_missing(spark, sf_dir):
    a, b = t.sides(spark, sf_dir, dated=True)
    return windowed_diffs(window_presence(a, b, _order_windows(spark, sf_dir), "placed", "placed"))


@query("windowed_ruleset", f"""{t.SIDES_SQL}, {_ORDER_WINDOWS_SQL},
aw AS (SELECT * FROM a JOIN w ON placed >= start AND placed < "end"),
bw AS (SELECT * FROM b JOIN w ON placed >= start AND placed < "end"),
x AS (WITH a AS (SELECT * REPLACE (window_id || chr(1) || compare_id AS compare_id) FROM aw WHERE window_id IN (SELECT window_id FROM bw)),
  b AS (SELECT * REPLACE (window_id || chr(1) || compare_id AS compare_id) FROM bw WHERE window_id IN (SELECT window_id FROM aw)),
  missing AS ({MISSING_SQL}) {RULESET_MISSING_SQL} UNION ALL {RULE_ROWS_SQL})
SELECT CAST(split_part("primaryId", chr(1), 1) AS INTEGER) AS window_id, * REPLACE (split_part("primaryId", chr(1), 2) AS "primaryId") FROM x""")
def windowed_rules(spark, sf_dir):
    a, b = t.sides(spark, sf_dir, dated=True)
    return windowed_ruleset(a, b, _order_windows(spark, sf_dir), "placed", "placed", t.scope(t.STATUS_RULE, t.PRICE_RULE))
