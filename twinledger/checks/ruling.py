"""Values, conditions and rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger.checks import tables as t
from twinledger.checks.registry import query
from twinledger.functions import values as V
from twinledger.functions.conditions import rule_condition
from twinledger.functions.ids import normalize_id
from twinledger.model import Rule
from twinledger.operators import compare as C
from twinledger.operators import rules as R



# --- values ------------------------------------------------------------------


@query("normalize_id", r"""
WITH s AS (SELECT o_orderkey, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'gid://shopify/Order/' || o_orderkey || '?key=9'
    WHEN '2-HIGH' THEN '  ORD-' || o_orderkey || ' '
    WHEN '3-MEDIUM' THEN 'A' || o_orderkey || 'B'
    WHEN '4-NOT SPECIFIED' THEN ' ' ELSE 'gid://shopify/Customer/' || o_custkey END AS raw FROM orders)
SELECT o_orderkey, trim(raw, ' ') AS plain,
       COALESCE(NULLIF(regexp_extract(trim(raw, ' '), 'gid://shopify/[^/]+/(\d+)(?:\?.*)?$', 1), ''),
                NULLIF(regexp_extract(trim(raw, ' '), '(\d+)$', 1), ''), trim(raw, ' ')) AS tail FROM s""")
def normalize_ids(spark, sf_dir):
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    raw = (
        F.when(p == "1-URGENT", F.concat(F.lit("gid://shopify/Order/"), key, F.lit("?key=9")))
        .when(p == "2-HIGH", F.concat(F.lit("  ORD-"), key, F.lit(" ")))
        .when(p == "3-MEDIUM", F.concat(F.lit("A"), key, F.lit("B")))
        .when(p == "4-NOT SPECIFIED", " ")
        .otherwise(F.concat(F.lit("gid://shopify/Customer/"), F.col("o_custkey").cast("string")))
    )
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey", normalize_id(raw).alias("plain"), normalize_id(raw, "SHOPIFY_GID_TAIL").alias("tail")
    )


def _nested(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.struct(
            F.struct(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("unit price")).alias("part"),
            F.array(F.col("l_suppkey"), F.col("l_partkey")).alias("keys"),
            F.array(F.struct(F.col("l_linestatus").alias("state"))).alias("states"),
        ).alias("doc"),
    )


@query("value_at_path", """
SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS nested, l_suppkey AS first_key, CAST(NULL AS VARCHAR) AS beyond,
       l_returnflag AS quoted, l_linestatus AS state, CAST(NULL AS VARCHAR) AS starred, CAST(NULL AS VARCHAR) AS absent
FROM lineitem""")
def value_at_path(spark, sf_dir):
    nested = _nested(spark, sf_dir)
    doc = V.Val(F.col("doc"), nested.schema["doc"].dataType)
    paths = {"nested": "$.part.id", "first_key": "keys[0]", "beyond": "keys[7]", "quoted": "part['unit price']",
             "state": "$.states[0].state", "starred": "states[*].state", "absent": "part.nothing.below"}
    found = nested.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[V.value_at_path(doc, path).col.alias(name) for name, path in paths.items()]
    )
    return found.withColumn("beyond", F.col("beyond").cast("string"))


@query("values_differ", """
SELECT o_orderkey,
       o_custkey IS DISTINCT FROM o_orderkey AS same_type,
       TRUE AS text_and_number,
       (o_orderkey IS NOT NULL OR o_totalprice IS NOT NULL) AS integer_and_decimal,
       (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END) IS DISTINCT FROM
       (CASE WHEN o_orderstatus <> 'O' THEN NULL ELSE o_orderpriority END) AS with_nulls,
       o_orderstatus <> 'F' AS null_types
FROM orders""")
def values_differ(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders").withColumns({
        "key_text": F.col("o_orderkey").cast("string"),
        "left": F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")),
        "right": F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")),
        "left_number": F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")),
        "no_text": F.lit(None).cast("string"),
    })

    def val(name):
        return V.Val(F.col(name), o.schema[name].dataType)

    pairs = {"same_type": ("o_custkey", "o_orderkey"), "text_and_number": ("key_text", "o_orderkey"),
             "integer_and_decimal": ("o_orderkey", "o_totalprice"), "with_nulls": ("left", "right"),
             "null_types": ("left_number", "no_text")}
    return o.select("o_orderkey", *[V.values_differ(val(a), val(b)).alias(n) for n, (a, b) in pairs.items()])


_TEXT_PAIRS_SQL = r"""WITH s AS (
  SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
         CASE l_returnflag WHEN 'A' THEN CAST(l_suppkey AS VARCHAR) WHEN 'N' THEN ' ' || l_suppkey || '.50 '
                           ELSE CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'x' || l_suppkey END END AS x,
         CASE l_linenumber WHEN 1 THEN '00' || (l_partkey % 20) WHEN 2 THEN '1e3' WHEN 3 THEN NULL
                           WHEN 4 THEN '-' || l_partkey ELSE CAST(l_suppkey AS VARCHAR) || '.0' END AS y FROM lineitem),
n AS (SELECT *, CASE WHEN regexp_full_match(trim(x), '-?\d+(\.\d+)?') THEN CAST(trim(x) AS DECIMAL(38,18)) END AS nx,
             CASE WHEN regexp_full_match(trim(y), '-?\d+(\.\d+)?') THEN CAST(trim(y) AS DECIMAL(38,18)) END AS ny FROM s),
c AS (SELECT *, CASE WHEN x IS NULL AND y IS NULL THEN 0 WHEN x IS NULL THEN -1 WHEN y IS NULL THEN 1
                     WHEN nx IS NOT NULL AND ny IS NOT NULL THEN CASE WHEN nx = ny THEN 0 WHEN nx < ny THEN -1 ELSE 1 END
                     WHEN x = y THEN 0 WHEN x < y THEN -1 ELSE 1 END AS o FROM n)"""


def _text_pairs(spark, sf_dir):
    supp, part = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    x = (
        F.when(flag == "A", supp).when(flag == "N", F.concat(F.lit(" "), supp, F.lit(".50 ")))
        .when(F.col("l_linestatus") != "O", F.concat(F.lit("x"), supp))
    )
    y = (
        F.when(line == 1, F.concat(F.lit("00"), (F.col("l_partkey") % 20).cast("string")))
        .when(line == 2, "1e3").when(line == 3, F.lit(None)).when(line == 4, F.concat(F.lit("-"), part))
        .otherwise(F.concat(supp, F.lit(".0")))
    )
    return t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                                                     x.alias("x"), y.alias("y"))


@query("matches_operator", _TEXT_PAIRS_SQL + """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, o = 0 AS eq, o <> 0 AS ne, o > 0 AS gt, o < 0 AS lt,
       o >= 0 AS ge, o <= 0 AS le, o = 0 AS other, l_suppkey > l_partkey AS number_gt FROM c""")
def matches_operator(spark, sf_dir):
    pairs = _text_pairs(spark, sf_dir)
    x, y = V.Val(F.col("x"), T.StringType()), V.Val(F.col("y"), T.StringType())
    ops = {"eq": "=", "ne": "!=", "gt": ">", "lt": "<", "ge": ">=", "le": "<=", "other": "~"}
    numbers = V.matches_operator(V.Val(F.col("l_suppkey"), T.LongType()), V.Val(F.col("l_partkey"), T.LongType()), ">")
    return pairs.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        *[V.matches_operator(x, y, op).alias(name) for name, op in ops.items()], numbers.alias("number_gt"),
    )


@query("violates_operator", _TEXT_PAIRS_SQL + """
SELECT l_orderkey, l_linenumber, count(*) FILTER (o <> 0) AS not_equal, count(*) FILTER (o <= 0) AS not_greater
FROM c GROUP BY l_orderkey, l_linenumber""")
def violates_operator(spark, sf_dir):
    x, y = V.Val(F.col("x"), T.StringType()), V.Val(F.col("y"), T.StringType())
    return _text_pairs(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(
        F.count_if(V.violates_operator(x, y, "=")).alias("not_equal"),
        F.count_if(V.violates_operator(x, y, ">")).alias("not_greater"),
    )


@query("pre_actions", _TEXT_PAIRS_SQL + r"""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
       CASE WHEN regexp_full_match(trim(x), '-?\d+') THEN CAST(TRY_CAST(trim(x) AS BIGINT) AS VARCHAR) END AS x_int,
       CASE WHEN regexp_full_match(trim(y), '-?\d+') THEN CAST(TRY_CAST(trim(y) AS BIGINT) AS VARCHAR) END AS y_int,
       CAST(CAST(nx AS DECIMAL(20,4)) AS VARCHAR) AS x_number, CAST(CAST(ny AS DECIMAL(20,4)) AS VARCHAR) AS y_number, x AS untouched FROM c""")
def pre_actions(spark, sf_dir):
    x, y = V.Val(F.col("x"), T.StringType()), V.Val(F.col("y"), T.StringType())

    def number(value):
        return V.apply_pre_actions(value, ["TO_NUMBER"]).col.cast("decimal(20,4)").cast("string")

    return _text_pairs(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        V.apply_pre_actions(x, "to_integer").col.cast("string").alias("x_int"),
        V.apply_pre_actions(y, ["STRING_TO_INT"]).col.cast("string").alias("y_int"),
        number(x).alias("x_number"), number(y).alias("y_number"),
        V.apply_pre_actions(x, ["TRIM"]).col.alias("untouched"),
    )


@query("canonical_system", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OMS' WHEN 'O' THEN
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'SHOPIFY' ELSE 'NETSUITE' END ELSE o_orderpriority END AS system
FROM orders""")
def canonical_system(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    raw = (
        F.when((status == "F") & (priority == "5-LOW"), " Order_System ").when(status == "F", "o m-s")
        .when((status == "O") & (priority == "1-URGENT"), "Shop-ify").when(status == "O", " net suite")
        .otherwise(priority)
    )
    aliases = {"OMS": "OMS", "ORDERSYSTEM": "OMS", "SHOPIFY": "SHOPIFY", "NETSUITE": "NETSUITE", "SAPI": "SAPI"}
    return t.table(spark, sf_dir, "orders").select("o_orderkey", V.canonical_system(raw, aliases).alias("system"))


@query("redact_secrets", r"""
WITH s AS (SELECT doc_id, text || ' Token : ' || doc_id || ', apiToken=' || lang || ') PASSWORD=' || source AS raw FROM documents),
m AS (SELECT doc_id, regexp_replace(raw, '(password|privateKey|apiToken|token)\s*[:=]\s*[^,\s)]+', '\1=***', 'gi') AS masked FROM s)
SELECT doc_id, md5(masked) AS masked, md5(substring(masked, 1, 3900)) AS message FROM m""")
def redact_secrets(spark, sf_dir):
    raw = F.concat(
        F.col("text"), F.lit(" Token : "), F.col("doc_id").cast("string"), F.lit(", apiToken="), F.col("lang"),
        F.lit(") PASSWORD="), F.col("source"),
    )
    return t.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(V.redact_secrets(raw)).alias("masked"),
        F.md5(V.redact_secrets(raw, V.MESSAGE_LENGTH)).alias("message"),
    )


@query("normalize_scalars", r"""
WITH s AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN ' Yes ' WHEN 'SMALL' THEN 'off' WHEN 'LARGE' THEN '1'
       WHEN 'PROMO' THEN '' ELSE p_type END AS word,
       CASE p_type WHEN 'ECONOMY' THEN '  ' || p_size WHEN 'SMALL' THEN '99999999999' ELSE p_name END AS num,
       CASE WHEN p_size < 10 THEN '  ' ELSE ' ' || p_name || ' ' END AS txt FROM part)
SELECT p_partkey, CASE WHEN lower(trim(word)) IN ('y','yes','true','1','on') THEN TRUE
                       WHEN lower(trim(word)) IN ('n','no','false','0','off') THEN FALSE ELSE FALSE END AS flag,
       COALESCE(TRY_CAST(CASE WHEN regexp_full_match(trim(num), '[+-]?\d+') THEN trim(num) END AS INTEGER), -1) AS small,
       CAST(TRY_CAST(CASE WHEN regexp_full_match(trim(num), '[+-]?\d+') THEN trim(num) END AS BIGINT) AS VARCHAR) AS large,
       NULLIF(trim(txt), '') AS txt FROM s""")
def normalize_scalars(spark, sf_dir):
    kind, size, name = F.col("p_type"), F.col("p_size"), F.col("p_name")
    word = (F.when(kind == "ECONOMY", " Yes ").when(kind == "SMALL", "off").when(kind == "LARGE", "1")
            .when(kind == "PROMO", "").otherwise(kind))
    num = (F.when(kind == "ECONOMY", F.concat(F.lit("  "), size.cast("string"))).when(kind == "SMALL", "99999999999")
           .otherwise(name))
    txt = F.when(size < 10, "  ").otherwise(F.concat(F.lit(" "), name, F.lit(" ")))
    return t.table(spark, sf_dir, "part").select(
        "p_partkey", V.norm_bool(word).alias("flag"), V.norm_int(num, -1).alias("small"),
        V.norm_long(num).cast("string").alias("large"), V.norm_text(txt, True).alias("txt"),
    )


# --- rules -------------------------------------------------------------------


@query("rule_condition", """
WITH s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority FROM orders)
SELECT o_orderkey, COALESCE(NOT contains(priority, 'LOW'), TRUE) AS c1, COALESCE(contains(priority, 'LOW'), FALSE) AS c2,
       o_totalprice >= 250000 AS c3, o_orderstatus IS NOT DISTINCT FROM 'F' AS c4, o_orderstatus <> 'F' AS c5,
       priority IS NULL AS c6, o_custkey < 100 AS c7, o_custkey <= 100.5 AS c8, FALSE AS c9, TRUE AS c10
FROM s""")
def rule_conditions(spark, sf_dir):
    facts = t.table(spark, sf_dir, "orders").withColumn(
        "priority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    )
    texts = ["priority does not contain LOW", "priority contains 'LOW'", "o_totalprice greater than or equals 250000",
             "o_orderstatus is F", 'o_orderstatus is not "F"', "priority equals null", "o_custkey < 100",
             "o_custkey less than or equals 100.5", "nowhere equals 1", "nowhere not equals 1"]
    return facts.select(
        "o_orderkey",
        *[rule_condition(text, facts.schema).alias(f"c{i}") for i, text in enumerate(texts, start=1)],
    )


FACT_RULES = [
    Rule("BIG", 10, text="o_totalprice > 400000"), Rule("OPEN", 20, text="o_orderstatus is O"),
    Rule("URGENT", 20, text="o_orderpriority contains URGENT"), Rule("OFF", 5, text="o_custkey > 0", enabled=False),
]
_MATCHED_SQL = """m AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 400000 THEN 'BIG' END,
   CASE WHEN o_orderstatus = 'O' THEN 'OPEN' END, CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'URGENT' END) AS matched
 FROM orders)"""


@query("execute_rules", f"WITH {_MATCHED_SQL} SELECT o_orderkey, matched FROM m WHERE matched <> ''")
def execute_rules(spark, sf_dir):
    marked, _ = R.execute_rules(t.table(spark, sf_dir, "orders"), FACT_RULES)
    return marked.select("o_orderkey", F.array_join(R.MATCHED, ",").alias("matched"))


@query("rule_fire_counts", f"""WITH {_MATCHED_SQL}
SELECT r AS "ruleId", count(*) AS fired FROM (SELECT unnest(string_split(matched, ',')) AS r FROM m WHERE matched <> '') GROUP BY r""")
def rule_fire_counts(spark, sf_dir):
    return R.rule_fire_counts(R.execute_rules(t.table(spark, sf_dir, "orders"), FACT_RULES)[0])


def _pairs(spark, sf_dir):
    return C.matched_pairs(*t.sides(spark, sf_dir), "ORDERS", "ORDER")


_DIFF_TAIL = 'CAST(NULL AS VARCHAR) AS "presentIn", CAST(NULL AS VARCHAR) AS "missingIn", CAST(NULL AS VARCHAR) AS data'


@query("field_comparison", f"""{t.SIDES_SQL}
SELECT 'FIELD_MISMATCH' AS "diffType", 'ORDERS' AS "compareScopeId", 'ORDER' AS "objectType", a.compare_id AS "primaryId",
       'price' AS field, a.price AS "file1Value", b.price AS "file2Value", {_DIFF_TAIL}, 'RISE' AS "ruleId",
       'INFO' AS severity, 'price differs between file 1 and file 2' AS message
FROM a JOIN b USING (compare_id) WHERE CAST(a.price AS DECIMAL(15,2)) < CAST(b.price AS DECIMAL(15,2))""")
def field_comparison(spark, sf_dir):
    rule = Rule("RISE", 1, "FIELD_COMPARISON", severity="INFO", expression={
        "file1FieldPath": "$.price", "file2FieldPath": "price", "operator": ">="})
    return R.execute_pair_rules(_pairs(spark, sf_dir), [rule])[0]


@query("business_rule_diff", f"""{t.SIDES_SQL}
SELECT 'REVIEW' AS "diffType", 'ORDERS' AS "compareScopeId", 'ORDER' AS "objectType", a.compare_id AS "primaryId",
       CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS "file1Value", CAST(NULL AS VARCHAR) AS "file2Value",
       {_DIFF_TAIL}, 'HELD' AS "ruleId", 'WARN' AS severity, 'Held on one side' AS message
FROM a JOIN b USING (compare_id) WHERE b.status = 'X' AND a.status <> 'X'""")
def business_rule_diff(spark, sf_dir):
    rule = Rule("HELD", 1, "FUNCTION", diff_type="REVIEW", severity="WARN", message="Held on one side",
                function=lambda p: (F.col("file2.status") == "X") & (F.col("file1.status") != "X"))
    return R.execute_pair_rules(_pairs(spark, sf_dir), [rule])[0]


@query("execute_matched_pair_rules", f"""{t.SIDES_SQL}, p AS (
  SELECT a.compare_id, a.status AS s1, b.status AS s2, a.price AS p1, b.price AS p2 FROM a JOIN b USING (compare_id))
SELECT 'FIELD_MISMATCH' AS "diffType", compare_id AS "primaryId", 'status' AS field, s1 AS "file1Value", s2 AS "file2Value",
       'STATUS' AS "ruleId" FROM p WHERE s1 <> s2
UNION ALL SELECT 'FIELD_MISMATCH', compare_id, 'price', p1, p2, 'PRICE' FROM p
       WHERE CAST(p1 AS DECIMAL(15,2)) <> CAST(p2 AS DECIMAL(15,2))
UNION ALL SELECT 'BUSINESS_RULE_DIFF', compare_id, NULL, NULL, NULL, 'BOTH' FROM p
       WHERE s1 <> s2 AND CAST(p1 AS DECIMAL(15,2)) <> CAST(p2 AS DECIMAL(15,2))""")
def execute_matched_pair_rules(spark, sf_dir):
    both = Rule("BOTH", 30, "FUNCTION", function=lambda p: (F.col("file1.status") != F.col("file2.status"))
                & (F.col("file1.price") != F.col("file2.price")))
    broken = Rule("BROKEN", 40, "FUNCTION", function=lambda p: F.col("file1.nothing") > 1)
    rows, _, warnings = R.execute_pair_rules(_pairs(spark, sf_dir), [t.STATUS_RULE, t.PRICE_RULE, both, broken])
    assert len(warnings) == 1
    return rows.select("diffType", "primaryId", "field", "file1Value", "file2Value", "ruleId")


@query("silent_rule_warnings", f"""{t.SIDES_SQL}
SELECT 'RuleSet RS_ORDERS matched compareScope=ORDERS primaryId=' || a.compare_id || ' but emitted no diff rows.' AS warning
FROM a JOIN b USING (compare_id) WHERE contains(a.compare_id, '77') AND a.status = b.status""")
def silent_rule_warnings(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    compiled, _ = R.compile_rules(pairs, [t.STATUS_RULE, Rule("LUCKY", 5, text="primaryId contains '77'")])
    return R.silent_warnings(pairs, compiled, "RS_ORDERS")


@query("classify_cascade", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 450000 THEN 'BIG_DONE'
       WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' WHEN o_totalprice < 50000 THEN 'SMALL' ELSE 'OTHER' END AS class
FROM orders""")
def classify_cascade(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    rules = [((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 450000), "BIG_DONE"),
             (F.col("o_orderpriority") == "1-URGENT", "URGENT"), (F.col("o_totalprice") < 50000, "SMALL")]
    return R.classify_cascade(orders, rules, "class", "OTHER").select("o_orderkey", "class")
