"""JSON-schema jobs and mapping readiness."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from twinledger.checks import tables as t
from twinledger.checks.registry import query
from twinledger.operators import jsonschema as J
from twinledger.operators.readiness import mapping_readiness


def _order_documents(spark, sf_dir):
    """Nested documents whose shape varies with status and priority."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    amount = (
        F.when(status == "F", F.col("o_totalprice").cast("decimal(15,2)").cast("string"))
        .when(status == "O", key).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    )
    lines = F.when(priority == "1-URGENT", F.concat(F.lit('[{"sku":'), cust, F.lit("},{\"qty\":2}]"))).otherwise("[]")
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit('{"id":'), key, F.lit(',"amount":'), amount, F.lit(',"note":'),
                 F.when(priority == "5-LOW", '"low"').otherwise("null"), F.lit(',"lines":'), lines, F.lit("}")).alias("doc"),
    )


_DOCS_SQL = """docs AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
  '{"id":' || o_orderkey || ',"amount":' || CASE o_orderstatus WHEN 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)
     WHEN 'O' THEN CAST(o_orderkey AS VARCHAR) ELSE '"' || o_orderkey || '"' END || ',"note":'
  || CASE WHEN o_orderpriority = '5-LOW' THEN '"low"' ELSE 'null' END || ',"lines":'
  || CASE WHEN o_orderpriority = '1-URGENT' THEN '[{"sku":' || o_custkey || '},{"qty":2}]' ELSE '[]' END || '}' AS doc FROM orders)"""
_TYPES_SQL = _DOCS_SQL + """, raw AS (
  SELECT '$' AS path, json_type(doc, '$') AS k FROM docs UNION ALL SELECT '$.id', json_type(doc, '$.id') FROM docs
  UNION ALL SELECT '$.amount', json_type(doc, '$.amount') FROM docs UNION ALL SELECT '$.note', json_type(doc, '$.note') FROM docs
  UNION ALL SELECT '$.lines', json_type(doc, '$.lines') FROM docs
  UNION ALL SELECT '$.lines[*]', json_type(i, '$') FROM (SELECT unnest(CAST(doc->'$.lines' AS JSON[])) AS i FROM docs)
  UNION ALL SELECT '$.lines[*].' || key, json_type(i, '$.' || key) FROM (SELECT i, unnest(json_keys(i)) AS key
     FROM (SELECT unnest(CAST(doc->'$.lines' AS JSON[])) AS i FROM docs))),
typed AS (SELECT DISTINCT path, CASE k WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS type FROM raw)"""


@query("infer_schema", f"WITH {_TYPES_SQL} SELECT path, type FROM typed")
def infer_schema(spark, sf_dir):
    return J.infer_schema(_order_documents(spark, sf_dir), "doc")


@query("infer_schema_strict", """
SELECT '{"additionalProperties": false, "properties": {"k": {"type": "' ||
       CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END
       || '"}}, "required": ["k"], "type": "object"}' AS schema_text FROM events GROUP BY 1""")
def infer_schema_strict(spark, sf_dir):
    return J.infer_schema(t.table(spark, sf_dir, "events"), "props", strict=True)


def _part_schemas(spark, sf_dir):
    """A stored schema per part: an array of items for small parts, with a shared definition."""
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    body = F.concat(
        F.lit('{"type":"object","required":["id"],"properties":{"id":{"type":"integer"},"'), name,
        F.lit('":{"type":"array","items":{"$ref":"#/definitions/cell"}}'),
    )
    small = F.col("p_size") < 25
    definitions = F.lit('"definitions":{"cell":{"type":"object","properties":{"size":{"type":"number"}}}}}')
    whole = F.when(small, F.concat(F.lit('{"type":"array","items":'), body, F.lit("}},"), definitions)).otherwise(
        F.concat(body, F.lit("},"), definitions)
    )
    return t.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("schema_id"), name.alias("name"), small.alias("small"), whole.alias("schema_text")
    )


_SCHEMAS_SQL = "s AS (SELECT p_partkey AS schema_id, replace(p_name, ' ', '_') AS name, p_size < 25 AS small FROM part)"


@query("merge_schemas", f"""WITH {_SCHEMAS_SQL}, r AS (
  SELECT '$' AS p, 'array' AS t FROM s WHERE small UNION SELECT '$[*]', 'object' FROM s WHERE small
  UNION SELECT '$[*].id', 'integer' FROM s WHERE small UNION SELECT '$[*].' || name, 'array' FROM s WHERE small
  UNION SELECT '$', 'object' FROM s WHERE NOT small UNION SELECT '$.id', 'integer' FROM s WHERE NOT small
  UNION SELECT '$.' || name, 'array' FROM s WHERE NOT small)
SELECT p AS path, string_agg(DISTINCT t, ',' ORDER BY t) AS types FROM r GROUP BY p""")
def merge_schemas(spark, sf_dir):
    return J.merge_schemas(_part_schemas(spark, sf_dir))


@query("flatten_schema", f"""WITH {_SCHEMAS_SQL}, f AS (
  SELECT schema_id, '[0]' AS "fieldPath", '[0]' AS "fieldName", 'object' AS type, FALSE AS required, 1 AS depth FROM s WHERE small
  UNION ALL SELECT schema_id, CASE WHEN small THEN '[0].' ELSE '' END || 'id', 'id', 'integer', TRUE, CASE WHEN small THEN 2 ELSE 1 END FROM s
  UNION ALL SELECT schema_id, CASE WHEN small THEN '[0].' ELSE '' END || name, name, 'array', FALSE, CASE WHEN small THEN 2 ELSE 1 END FROM s
  UNION ALL SELECT schema_id, CASE WHEN small THEN '[0].' ELSE '' END || name || '.[0]', '[0]', 'object', FALSE, CASE WHEN small THEN 3 ELSE 2 END FROM s
  UNION ALL SELECT schema_id, CASE WHEN small THEN '[0].' ELSE '' END || name || '.[0].size', 'size', 'number', FALSE, CASE WHEN small THEN 4 ELSE 3 END FROM s)
SELECT schema_id, "fieldPath", "fieldName", type, required, CAST(depth AS INTEGER) AS depth FROM f""")
def flatten_schema(spark, sf_dir):
    return J.flatten_schema(_part_schemas(spark, sf_dir))


@query("resolve_key_paths", f"""WITH {_SCHEMAS_SQL}
SELECT schema_id, p AS "jsonPath", p AS resolved
FROM (SELECT schema_id, '$' || CASE WHEN small THEN '[*]' ELSE '' END || '.' || name || '[*].size' AS p FROM s)""")
def resolve_key_paths(spark, sf_dir):
    return J.resolve_key_paths(J.schema_paths(_part_schemas(spark, sf_dir)), "size")


@query("path_in_schema", f"""WITH {_SCHEMAS_SQL}, e AS (
  SELECT schema_id * 4 AS member_id, schema_id, TRUE AS in_schema FROM s
  UNION ALL SELECT schema_id * 4 + 1, schema_id, TRUE FROM s
  UNION ALL SELECT schema_id * 4 + 2, schema_id, small FROM s
  UNION ALL SELECT schema_id * 4 + 3, schema_id, FALSE FROM s) SELECT * FROM e""")
def path_in_schema(spark, sf_dir):
    schemas = _part_schemas(spark, sf_dir)
    expressions = [F.concat(F.lit("$."), F.col("name"), F.lit("[0].size|SHOPIFY_GID_TAIL")), F.lit("id"),
                   F.lit("$[3].id"), F.concat(F.col("name"), F.lit(".[*].weight"))]
    members = schemas.select("schema_id", F.posexplode(F.array(*expressions)).alias("pos", "id_expression")).select(
        (F.col("schema_id") * 4 + F.col("pos")).alias("member_id"), "schema_id", "id_expression"
    )
    return J.path_in_schema(members, J.schema_paths(schemas)).select("member_id", "schema_id", "in_schema")


RECORD_SCHEMA = {
    "type": "array",
    "items": {
        "type": "object",
        "required": ["id", "amount"],
        "additionalProperties": False,
        "properties": {
            "id": {"type": "integer", "minimum": 100},
            "amount": {"type": "number"},
            "note": {"enum": [None, "low"]},
            "lines": {"type": "array", "items": {"type": "object", "required": ["sku"]}},
        },
    },
}


@query("validate_records", f"""WITH {_DOCS_SQL}, v AS (
  SELECT o_orderkey AS i, 1 AS k, '$.id: violates minimum 100' AS m FROM docs WHERE o_orderkey < 100
  UNION ALL SELECT o_orderkey, 2, '$.amount: expected number' FROM docs WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 3, '$.lines[*]: required property ''sku'' not found' FROM docs WHERE o_orderpriority = '1-URGENT')
SELECT i AS index, 'Item ' || i || ': ' || m AS message FROM v""")
def validate_records(spark, sf_dir):
    return J.record_errors(_order_documents(spark, sf_dir), "doc", RECORD_SCHEMA, "o_orderkey").select("index", "message")


@query("validate_records_report", f"""WITH {_DOCS_SQL}, v AS (
  SELECT o_orderkey AS i, 1 AS k, '$.id: violates minimum 100' AS m FROM docs WHERE o_orderkey < 100
  UNION ALL SELECT o_orderkey, 2, '$.amount: expected number' FROM docs WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 3, '$.lines[*]: required property ''sku'' not found' FROM docs WHERE o_orderpriority = '1-URGENT')
SELECT i AS index, 'Item ' || i || ': ' || m AS message FROM v ORDER BY i, k LIMIT 100""")
def validate_records_report(spark, sf_dir):
    return J.validate_records(_order_documents(spark, sf_dir), "doc", RECORD_SCHEMA, "o_orderkey").select("index", "message")


@query("mapping_readiness", f"""WITH {_SCHEMAS_SQL}, owned AS (SELECT c_custkey, c_mktsegment FROM customer),
m AS (SELECT p_partkey AS k, p_size, 'System ' || p_partkey AS label, p_partkey % 7 AS kind, replace(p_name, ' ', '_') AS name, p_brand FROM part),
e AS (SELECT k, CASE kind WHEN 0 THEN label || ' is missing an id field expression.' END AS i1,
  CASE WHEN kind = 1 THEN label || ' is missing a saved schema.'
       WHEN kind = 2 THEN label || ' schema ''nowhere' || k || ''' is not saved.'
       WHEN p_brand = 'Brand#1' THEN label || ' schema ''schema' || k || ''' is not available in your active tenant.'
       WHEN p_brand = 'Brand#2' THEN label || ' schema ''schema' || k || ''' does not contain schema text.'
       WHEN kind = 0 THEN label || ' id field ''null'' is not present in schema ''schema' || k || '''.'
       WHEN kind = 3 THEN label || ' id field ''$.nothing.id'' is not present in schema ''schema' || k || '''.' END AS i2 FROM m)
SELECT k AS member_id, i1 AS issue FROM e WHERE i1 IS NOT NULL UNION ALL SELECT k, i2 FROM e WHERE i2 IS NOT NULL""")
def readiness(spark, sf_dir):
    part = t.table(spark, sf_dir, "part")
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 7
    members = part.select(
        key.alias("member_id"), F.concat(F.lit("System "), key.cast("string")).alias("system_label"),
        F.when(kind == 1, "  ").when(kind == 2, F.concat(F.lit("nowhere"), key.cast("string")))
        .otherwise(F.concat(F.lit("schema"), key.cast("string"))).alias("schema_name"),
        F.when(kind == 0, F.lit(None)).when(kind == 3, "nothing.id").when(kind == 4, "$.id").otherwise("id").alias("id_expression"),
    )
    schemas = _part_schemas(spark, sf_dir).join(part.select(key.alias("schema_id"), "p_brand"), "schema_id").select(
        F.concat(F.lit("schema"), F.col("schema_id").cast("string")).alias("schema_name"),
        F.when(F.col("p_brand") == "Brand#1", "OTHER").otherwise("TENANT").alias("companyUserGroupId"),
        F.when(F.col("p_brand") == "Brand#2", " ").otherwise(F.col("schema_text")).alias("schema_text"),
    )
    return mapping_readiness(members, schemas, "TENANT")


def schema_document(spark, sf_dir) -> str:
    """The assembled schema of the order documents, for reading."""
    rows = J.infer_schema(_order_documents(spark, sf_dir), "doc").collect()
    return json.dumps(J.assemble_schema([tuple(r) for r in rows]), indent=1)
