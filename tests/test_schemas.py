"""JSON-schema jobs on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from twinledger.model import ConfigError
from twinledger.operators import jsonschema as J
from twinledger.operators.readiness import mapping_readiness


def texts(spark, *documents):
    return spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)],
                                 "i long, doc string")


def inferred(spark, *documents):
    return J.assemble_schema([tuple(r) for r in J.infer_schema(texts(spark, *documents), "doc").collect()])


def test_infer_scalars(spark):
    schema = inferred(spark, {"depot": "north", "weight": 12.25, "crates": 7, "sealed": False, "seal_no": None})
    assert {k: v["type"] for k, v in schema["properties"].items()} == {
        "crates": "integer", "depot": "string", "sealed": "boolean", "weight": "number", "seal_no": "null"}


def test_infer_merges_documents(spark):
    schema = inferred(spark, {"berth": "B7", "draft": 4}, {"draft": {"fore.aft": 3}, "flags": []}, {"draft": 4.75, "flags": ["day", None, 6], "crew": 11})
    assert sorted(schema["properties"]) == ["berth", "crew", "draft", "flags"]
    assert schema["properties"]["flags"] == {"type": "array", "items": {"type": ["integer", "null", "string"]}}
    assert schema["properties"]["draft"] == {"anyOf": [
        {"type": "object", "properties": {"fore.aft": {"type": "integer"}}}, {"type": "number"}]}


def test_infer_strict_keeps_shapes_apart(spark):
    rows = [json.loads(r[0]) for r in J.infer_schema(texts(spark, {"a": [1, "x"]}, {"a": [1, "y"]}, {"b": 1}), "doc", strict=True).collect()]
    assert len(rows) == 2
    first = next(r for r in rows if "a" in r["properties"])
    assert first == {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
        "a": {"type": "array", "items": {"anyOf": [{"type": "integer"}, {"type": "string"}]}}}}


def test_any_depth_is_kept(spark):
    rows = J.infer_schema(texts(spark, "[" * 300 + "1" + "]" * 300), "doc").collect()
    assert ("$" + "[*]" * 300, "integer") in {tuple(r) for r in rows}
    deep = {"type": "string"}
    for i in range(120):
        deep = {"type": "object", "properties": {f"k{i}": deep}}
    df = spark.createDataFrame([("s", json.dumps(deep))], "schema_id string, schema_text string")
    assert J.flatten_schema(df).count() == 120 and J.merge_schemas(df).count() == 121 and J.schema_paths(df).count() == 120


def test_unreadable_texts_are_listed_not_fatal(spark):
    df = texts(spark, {"a": 1}, "{broken", '{"a": "x"}')
    assert {tuple(r) for r in J.infer_schema(df, "doc").collect()} == {("$", "object"), ("$.a", "integer"), ("$.a", "string")}
    assert J.infer_schema(df, "doc", strict=True).count() == 2
    assert [r["i"] for r in J.unreadable(df, "doc").collect()] == [1]


def test_recursive_schemas_end(spark):
    schema = {"$ref": "#/definitions/n", "definitions": {"n": {"type": "object", "properties": {
        "left": {"$ref": "#/definitions/n"}, "right": {"$ref": "#/definitions/n"}, "value": {"type": "integer"}}}}}
    df = spark.createDataFrame([("s", json.dumps(schema))], "schema_id string, schema_text string")
    assert [r["jsonPath"] for r in J.schema_paths(df).collect()] == ["$.value"]
    assert [r["fieldPath"] for r in J.flatten_schema(df).collect()] == ["value"]


def test_flatten(spark):
    schema = {
        "type": "object", "required": ["order"],
        "definitions": {"money": {"type": "object", "properties": {"amount": {"type": "string"}}}},
        "properties": {
            "order": {"$ref": "#/definitions/money"},
            "lines": {"type": "array", "items": {"type": "object", "properties": {"sku": {"type": "string"}}}},
            "either": {"anyOf": [{"type": "null"}, {"type": "object", "properties": {"x": {}}}]},
        },
    }
    df = spark.createDataFrame([("s", json.dumps(schema)), ("bad", "{"), ("none", None)], "schema_id string, schema_text string")
    rows = [tuple(r)[1:] for r in J.flatten_schema(df).collect()]
    assert rows == [
        ("order", "order", "object", True, 1), ("order.amount", "amount", "string", False, 2),
        ("lines", "lines", "array", False, 1), ("lines.[0]", "[0]", "object", False, 2),
        ("lines.[0].sku", "sku", "string", False, 3), ("either", "either", "any", False, 1),
        ("either.x", "x", "string", False, 2)]


def errors(spark, schema, *documents):
    return [r["message"] for r in J.record_errors(texts(spark, *documents), "doc", schema, "i").orderBy("index", "pos").collect()]


def test_validate_items(spark):
    schema = {"type": "array", "items": {"type": "object", "required": ["plate", "axles"]}}
    assert errors(spark, schema, {"plate": "HH 1", "axles": 2}, {"plate": "HH 2"}, {"axles": 3, "plate": None}) == [
        "Item 1: $: required property 'axles' not found"]


def test_validation_limit_and_truncation(spark):
    df = texts(spark, {"a": "x", "b": "y", "c": "z"}, {"a": 1})
    schema = {"additionalProperties": {"type": "integer"}}
    for most, truncated in ((2, True), (3, False), (7, False)):
        assert J.validation_summary(df, "doc", schema, "i", most) == {"valid": False, "count": min(most, 3), "truncated": truncated}
        assert J.validate_records(df, "doc", schema, "i", most).count() == min(most, 3)
    assert J.validation_summary(df, "doc", {}, "i") == {"valid": True, "count": 0, "truncated": False}


def test_file_items_are_numbered_by_file(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_text("".join('{"n": 1}\n' if i != 40 else '{"n": "x"}\n' for i in range(60)))
    found = J.file_errors(spark, str(tmp_path), {"properties": {"n": {"type": "integer"}}}, json_lines=True).collect()
    assert sorted((r["file"].rsplit("/", 1)[-1], r["index"]) for r in found) == [("one", 40), ("two", 40)]


@pytest.mark.parametrize("schema, good, bad", [
    ({"type": "integer"}, [1, 1.0, 1e22], [1.5, "1", None, True]),
    ({"enum": [9007199254740992], "minimum": 9007199254740992}, [9007199254740992], [9007199254740993, 9007199254740991]),
    ({"patternProperties": {"^x-": {"type": "string"}}, "additionalProperties": False}, [{"x-a": "s"}, {}], [{"x-a": 1}, {"y": "s"}]),
    ({"allOf": [{"uniqueItems": True}]}, [[1, 2], [], "aa"], [[1, 1], [{"a": 1}, {"a": 1}]]),
    ({"multipleOf": 0.1}, [0.3, 7, "x"], [0.35]),
    ({"allOf": [{"contains": {"type": "string"}}]}, [[1, "x"], 5], [[1], []]),
    ({"minProperties": 1, "maxProperties": 2, "propertyNames": {"pattern": "^a"}}, [{"a": 1}, {"a": 1, "ab": 2}, 3], [{}, {"a": 1, "ab": 1, "ac": 1}, {"b": 1}]),
    ({"dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, [{"a": 1, "b": 2}, {"c": 1, "d": 1}, {}], [{"a": 1}, {"c": 1}]),
    ({"if": {"properties": {"k": {"const": 1}}}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}, [{"k": 1, "x": 0}, {"k": 2, "y": 0}], [{"k": 1}, {"k": 2, "x": 0}]),
    ({"allOf": [{"items": [{"type": "integer"}], "additionalItems": False}]}, [[1], []], [[1, 2]]),
    ({"type": ["number", "null"]}, [1, 2.5, None, 1e40], ["x"]),
    ({"enum": ["a", 1, None]}, ["a", 1, None], ["b", 2]),
    ({"const": {"k": [1]}}, [{"k": [1]}], [{"k": [2]}, 1]),
    ({"minimum": 2, "exclusiveMaximum": 5}, [2, 4.9, "text"], [1, 5]),
    ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, ["ab", "abc", 5], ["a", "abcd", "bb"]),
    ({"properties": {"x.y": {"type": "string"}}, "additionalProperties": {"type": "integer"}},
     [{"x.y": "s", "o": 1}], [{"x.y": 1}, {"o": "s"}]),
    ({"allOf": [{"items": {"type": "integer"}, "minItems": 1, "maxItems": 2}]}, [[1], [1, 2], "no array"], [[], [1, "x"], [1, 2, 3]]),
    ({"allOf": [{"items": [{"type": "string"}, {"type": "integer"}]}]}, [["a", 1], []], [[1, 1]]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 3], [1]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, [1, 3.5], [4, 2.5]),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}], "not": {"const": 2}}, [1, 1.5], [0, 2, 3]),
    ({"$ref": "#/definitions/p", "definitions": {"p": {"required": ["a"]}}}, [{"a": None}], [{}]),
    ({"properties": {"it's": {"type": "integer"}, 'say "x"': {"type": "string"}, "a'b\"c": {"const": 1}, "back\\s": {"type": "null"}}, "required": ["it's"]},
     [{"it's": 1, 'say "x"': "y", "a'b\"c": 1, "back\\s": None}, {"it's": 2}], [{"it's": "1"}, {"it's": 1, 'say "x"': 2}, {"it's": 1, "a'b\"c": 2}, {}, {"it's": 1, "back\\s": 0}]),
    ({"enum": [[{"b": 1, "a": 2}], {"x": [1.0, {"y": None}]}]}, [[{"a": 2, "b": 1}], [{"b": 1.0, "a": 2}], {"x": [1, {"y": None}]}],
     [[{"a": 2}], [{"a": 2, "b": 1, "c": 3}], [{"a": 2, "b": 1}, 1], {"x": [1, {}]}, {"x": [1, {"y": 0}]}, []]),
    ({"const": [1.0]}, [[1], [1.0]], [[1, 1], ["1"], 1, []]),
    ({"multipleOf": 0.0001}, [12345678901234567890123456789, 0.0003], [0.00015]),
    ({"multipleOf": 7}, [7 * 10**30], [7 * 10**30 + 1]),
])
def test_keywords(spark, schema, good, bad):
    failed = {r["index"] for r in J.record_errors(texts(spark, *map(json.dumps, good + bad)), "doc", schema, "i").select("index").distinct().collect()}
    assert failed == set(range(len(good), len(good) + len(bad)))


def test_unreadable_text_is_a_violation(spark):
    assert errors(spark, {"type": "object"}, "{broken") == ["Item 0: $: not valid JSON"]


def test_recursive_schema_is_refused():
    schema = {"$ref": "#/definitions/n", "definitions": {"n": {"properties": {"next": {"$ref": "#/definitions/n"}}}}}
    with pytest.raises(ConfigError, match="refers to itself"):
        J.validation_errors(F.lit(1), schema)


ORDERS = {"type": "array", "items": {"type": "object", "properties": {"data": {"type": "object", "properties": {"orders": {
    "type": "object", "properties": {"edges": {"type": "array", "items": {"type": "object", "properties": {
        "node": {"anyOf": [{"type": "object", "properties": {"id": {}, "legacyResourceId": {}}}]}}}}}}}}}}}


def test_paths_in_a_nested_schema(spark):
    schemas = spark.createDataFrame([("s", json.dumps(ORDERS))], "schema_id string, schema_text string")
    paths = J.schema_paths(schemas)
    members = spark.createDataFrame([
        ("m1", "s", "$.data.orders.edges[0].node.id|SHOPIFY_GID_TAIL"), ("m2", "s", "data.orders.edges.[0].node.id"),
        ("m3", "s", "$[*].data.orders.edges.node.id"), ("m4", "s", "legacyResourceId"), ("m5", "s", "$.data.orders"),
        ("m6", "s", "$.data[*].orders"), ("m7", "s", "$.data.orders.edges[0].node.sku"), ("m8", "s", None),
    ], "member_id string, schema_id string, id_expression string")
    found = {r["member_id"]: r["in_schema"] for r in J.path_in_schema(members, paths).collect()}
    assert found == {"m1": True, "m2": True, "m3": True, "m4": True, "m5": True, "m6": False, "m7": False, "m8": False}
    assert [tuple(r) for r in J.resolve_key_paths(paths, "id").collect()] == [
        ("s", "$[*].data.orders.edges[*].node.id", "$[*].data.orders.edges[*].node.id")]


def test_readiness(spark):
    schemas = spark.createDataFrame([("good", "T1", json.dumps(ORDERS)), ("foreign", "T2", json.dumps(ORDERS)), ("blank", "T1", " ")],
                                    "schema_name string, companyUserGroupId string, schema_text string")
    members = spark.createDataFrame([
        ("m1", "Web", "good", "data.orders.edges[0].node.id"), ("m2", "Web", None, None), ("m3", "Web", "foreign", "id"),
        ("m4", "Web", "blank", "id"), ("m5", "Web", "absent", "id"), ("m6", "Web", "good", "data.nothing"),
    ], "member_id string, system_label string, schema_name string, id_expression string")
    rows = {tuple(r) for r in mapping_readiness(members, schemas, "T1").collect()}
    assert rows == {
        ("m2", "Web is missing an id field expression."), ("m2", "Web is missing a saved schema."),
        ("m3", "Web schema 'foreign' is not available in your active tenant."),
        ("m4", "Web schema 'blank' does not contain schema text."), ("m5", "Web schema 'absent' is not saved."),
        ("m6", "Web id field '$.data.nothing' is not present in schema 'good'.")}


def test_a_catalog_in_one_split_is_read_by_many_tasks(spark):
    schemas = spark.createDataFrame([(str(i), json.dumps(ORDERS)) for i in range(40)] + [("0", "{broken"), (None, None)],
                                    "schema_id string, schema_text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        paths = J.schema_paths(schemas)
        assert paths.rdd.getNumPartitions() == 8 and J.flatten_schema(schemas).rdd.getNumPartitions() == 8
        members = schemas.select("schema_id", F.lit("data.orders.edges[0].node.id").alias("id_expression"), F.monotonically_increasing_id().alias("member_id"))
        checked = J.path_in_schema(members, paths)
        assert checked.groupBy("in_schema").count().orderBy("in_schema").collect() == [(False, 1), (True, 41)]
        plan = checked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
