"""Published example inputs with known results."""

import json

import pytest

from twinledger.functions.ids import parse_id_spec, join_record_root
from twinledger.model import CompareScope, ConfigError, Rule, SideConfig
from twinledger.plans.reconcile import (
    base_diff,
    read_side,
    reconcile_ruleset,
    reconcile_ruleset_files,
    reconcile_unified_files,
)

GID = "gid://shopify/Order/"


def order_doc(*tails, extra=()):
    nodes = [{"node": {"id": GID + t, "name": "#" + t, "createdAt": "2026-01-01"}} for t in tails]
    nodes += [{"node": {"id": GID + t, "name": "#dup" + t, "createdAt": "2026-01-02"}} for t in extra]
    return [{"data": {"orders": {"edges": nodes}}}]


FIRST = order_doc("6470622019715", "6470622478467", "6470624575619")
SECOND = order_doc("6470622478467", "6470624804995", "6470625460355")
DUPLICATED = order_doc("6470622019715", "6470622478467", extra=("6470622019715", "6470622478467"))
EMPTY = {"data": {"orders": {"edges": []}}}


def product_doc(rows):
    return [{"data": {"products": [{"productId": i, "sku": s, "price": p} for i, s, p in rows]}}]


PRODUCTS_1 = product_doc([("P100", "SKU-A", "10.00"), ("P200", "SKU-B", "20.00"), ("P300", "SKU-C", "30.00"),
                          ("P400", "SKU-D", "49.99")])
PRODUCTS_2 = product_doc([("P100", "SKU-A", "10.00"), ("P200", "SKU-B-ALT", "20.00"), ("P400", "SKU-D", "59.99"),
                          ("P500", "SKU-E", "15.00")])


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1))
        return str(path)

    return write


def order_scope(rules=()):
    side = {"id_expression": "node.id", "record_root": "data.orders.edges", "id_normalizer": "SHOPIFY_GID_TAIL",
            "file_type": "JSON"}
    return CompareScope("ORDERS", SideConfig(label="SHOPIFY", **side), SideConfig(label="OMS", **side),
                        object_type="ORDER", rule_set_id="RS", rules=tuple(rules))


def product_scope(rules=()):
    side = {"id_expression": "productId", "record_root": "data.products", "file_type": "JSON"}
    return CompareScope("PRODUCTS", SideConfig(label="OMS", **side), SideConfig(label="SHOPIFY", **side),
                        rule_set_id="RS", rules=tuple(rules))


def comparison(rule_id, path, message, sequence=0, **settings):
    return Rule(rule_id, sequence, "FIELD_COMPARISON", severity="WARN", message=message,
                expression={"file1FieldPath": path, "file2FieldPath": path, **settings})


def sides(spark, put, first, second, scope):
    return [read_side(spark, put(f"{n}.json", doc), side, "x", [])[0]
            for n, doc, side in (("a", first, scope.side1), ("b", second, scope.side2))]


def test_orders_with_one_overlap(spark, put):
    scope = order_scope()
    result = base_diff(*sides(spark, put, FIRST, SECOND, scope), scope)
    assert result.summary == {"missingInFile1Count": 2, "missingInFile2Count": 2, "differenceCount": 4,
                              "matchedPairCount": 1}
    rows = {(r["type"], r["id"]) for r in result.diffs.collect()}
    assert rows == {("MISSING_IN_FILE_2", "6470622019715"), ("MISSING_IN_FILE_2", "6470624575619"),
                    ("MISSING_IN_FILE_1", "6470624804995"), ("MISSING_IN_FILE_1", "6470625460355")}
    pair = result.pairs.collect()
    assert [p["primaryId"] for p in pair] == ["6470622478467"]
    assert pair[0]["file1"]["node"]["name"] == "#6470622478467"


def test_a_side_against_itself(spark, put):
    scope = order_scope()
    result = base_diff(*sides(spark, put, FIRST, FIRST, scope), scope)
    assert (result.summary["differenceCount"], result.summary["matchedPairCount"]) == (0, 3)
    assert result.diffs.count() == 0 and result.diffs.columns[0] == "type"


def test_empty_array_side(spark, put):
    scope = order_scope()
    result = base_diff(*sides(spark, put, FIRST, EMPTY, scope), scope)
    assert result.summary["missingInFile2Count"] == 3
    assert {r["type"] for r in result.diffs.collect()} == {"MISSING_IN_FILE_2"}


def test_duplicates_are_an_error(spark, put):
    scope = order_scope()
    with pytest.raises(ConfigError, match=r"FILE_1 \(SHOPIFY\).*6470622019715 \(2 rows\)"):
        base_diff(*sides(spark, put, DUPLICATED, SECOND, scope), scope)


def test_duplicates_collapse_without_active_rules(spark, put):
    scope = order_scope()
    result = reconcile_ruleset(*sides(spark, put, DUPLICATED, SECOND, scope), scope)
    assert (result.summary["differenceCount"], result.summary["matchedPairCount"]) == (3, 1)
    assert len(result.warnings) == 1 and "collapsed duplicate primaryId" in result.warnings[0]
    assert result.pairs is None and result.diffs.count() == 3


def test_product_rules(spark, put):
    scope = product_scope([comparison("SKU", "sku", "SKU mismatch", 10), comparison("PRICE", "price", "Price mismatch", 20)])
    result = reconcile_ruleset_files(spark, put("a.json", PRODUCTS_1), put("b.json", PRODUCTS_2), scope)
    rows = {(r["diffType"], r["primaryId"], r["field"], r["file1Value"], r["file2Value"], r["message"])
            for r in result.diffs.collect()}
    assert rows == {
        ("MISSING_IN_FILE_2", "P300", None, None, None, "Present in OMS, missing in SHOPIFY"),
        ("MISSING_IN_FILE_1", "P500", None, None, None, "Present in SHOPIFY, missing in OMS"),
        ("FIELD_MISMATCH", "P200", "sku", "SKU-B", "SKU-B-ALT", "SKU mismatch"),
        ("FIELD_MISMATCH", "P400", "price", "49.99", "59.99", "Price mismatch"),
    }
    s = result.summary
    assert (s["missingObjectDifferenceCount"], s["ruleDifferenceCount"], s["differenceCount"]) == (2, 2, 4)
    assert (s["matchedPairCount"], s["firedRuleCount"], s["ruleCount"]) == (3, 2, 2)


def test_a_broken_rule_keeps_base_differences(spark, put):
    broken = Rule("BROKEN", 10, "FUNCTION", function=lambda pairs: pairs["no_such_column"] > 1)
    scope = product_scope([broken])
    result = reconcile_ruleset_files(spark, put("a.json", PRODUCTS_1), put("b.json", PRODUCTS_2), scope)
    assert result.diffs.count() == 2
    assert result.summary["ruleDifferenceCount"] == 0
    assert any("BROKEN" in w for w in result.warnings) and any("preserved base" in w for w in result.warnings)


def test_csv_pair(spark, put):
    side = SideConfig("order_id", "CSV")
    result = reconcile_unified_files(spark, put("l.csv", "order_id\nA100\nA200\nA300\n"),
                                     put("r.csv", "order_id\nA200\nA300\nA400\n"), side, side)
    assert (result.summary["onlyInFile1Count"], result.summary["onlyInFile2Count"]) == (1, 1)
    assert result.summary["reconciliationType"] == "CSV"
    assert {(r["type"], r["id"]) for r in result.diffs.collect()} == {("missing_in_File2", "A100"), ("missing_in_File1", "A400")}


def test_csv_status_rule(spark, put):
    side = SideConfig("order_id", "CSV")
    scope = CompareScope("S", side, side, rules=(comparison("ST", "status", None, operator="="),))
    result = reconcile_ruleset_files(spark, put("l.csv", "order_id,status\nA100,open\nA200,closed\n"),
                                     put("r.csv", "order_id,status\nA100,pending\nA200,closed\n"), scope)
    rows = result.diffs.collect()
    assert len(rows) == 1 and rows[0]["message"] == "status differs between file 1 and file 2"


def test_two_layouts(spark, put):
    first = {"data": {"orders": {"edges": [{"node": {"id": GID + "1001", "status": "open"}}]}}}
    second = {"orders": [{"order_id": "1001", "status": "open"}]}
    result = reconcile_unified_files(
        spark, put("a.json", first), put("b.json", second),
        SideConfig("$.data.orders.edges[0].node.id|SHOPIFY_GID_TAIL", "JSON"), SideConfig("$.orders[0].order_id", "JSON"))
    assert result.summary["totalDifferences"] == 0


def test_missing_csv_column_is_explained(spark, put):
    path = put("a.csv", '{\n "x": 1\n}')
    with pytest.raises(ConfigError, match="looks like JSON"):
        read_side(spark, path, SideConfig("orderId", "CSV"), "x", [])
    headerless = put("b.csv", "1,2\n3,4\n")
    with pytest.raises(ConfigError, match="does not expose named headers"):
        read_side(spark, headerless, SideConfig("orderId", "CSV"), "x", [], has_header=False)


@pytest.mark.parametrize("expression, kind, path, normalizer", [
    ("legacyResourceId", "JSON", "$[*].legacyResourceId", None),
    ("$.data.orders.edges[0].node.legacyResourceId|shopify-gid-tail", "JSON",
     "$.data.orders.edges[*].node.legacyResourceId", "SHOPIFY_GID_TAIL"),
    ("data.orders.edges.[0].node.id", "JSON", "$.data.orders.edges[*].node.id", None),
    ("$.records[*].orderId", "CSV", "orderId", None),
    ("", "JSON", "$.id", None),
    (None, "CSV", "id", None),
])
def test_id_expressions(expression, kind, path, normalizer):
    spec = parse_id_spec(expression, kind)
    assert (spec.expression, spec.normalizer) == (path, normalizer)


def test_bad_id_expressions():
    with pytest.raises(ConfigError, match="Invalid JSONPath"):
        parse_id_spec("data.orders[0", "JSON")
    for code in ("TRAILING_DIGITS", "SHOPIFY_GID"):
        with pytest.raises(ConfigError, match="Unsupported ID normalizer"):
            parse_id_spec(f"id|{code}", "JSON")


def test_record_root_is_not_doubled():
    assert join_record_root("data.orders.edges", "node.id") == "$.data.orders.edges[*].node.id"
    assert join_record_root("data.orders.edges", "data.orders.edges[0].node.id") == "$.data.orders.edges[*].node.id"
    assert join_record_root(None, "id") == "id"
    assert join_record_root("$.rows[*]", "$.id") == "$.rows[*].id"


def test_schema_violations_are_advisory(spark, put):
    schema = {"type": "array", "items": {"type": "object", "required": ["sku"], "properties": {"id": {"type": "integer"}}}}
    side = SideConfig("id", "JSON", label="Web", schema=schema)
    result = reconcile_unified_files(spark, put("a.json", [{"id": 1, "sku": "x"}, {"id": 2}, {"id": 3, "sku": "z"}]),
                                     put("b.json", [{"id": 2, "sku": "y"}]), side, SideConfig("id", "JSON", label="Shop"))
    assert result.summary["totalDifferences"] == 2
    assert [r[0] for r in result.validation_errors.collect()] == ["Web: Item 1: $: required property 'sku' not found"]


def test_mapping_runs_only_when_ready(spark):
    from twinledger.model import MappingMember
    from twinledger.plans.reconcile import reconcile_by_mapping

    members = [MappingMember("OMS", "id", "CSV"), MappingMember("SHOPIFY", "id|SHOPIFY_GID_TAIL", "CSV", id_normalizer="shopify gid tail")]
    a = spark.createDataFrame([("1",), ("2",)], "id string")
    b = spark.createDataFrame([("gid://shopify/Order/2",), ("gid://shopify/Order/3?x=1",)], "id string")
    result = reconcile_by_mapping("M", members, a, b, "OMS", "SHOPIFY")
    assert {(r["type"], r["id"]) for r in result.diffs.collect()} == {("missing_in_SHOPIFY", "1"), ("missing_in_OMS", "3")}
    with pytest.raises(ConfigError, match="does not include system NETSUITE"):
        reconcile_by_mapping("M", members, a, b, "OMS", "NETSUITE")
    issues = spark.createDataFrame([("m1", "OMS is missing a saved schema.")], "member_id string, issue string")
    with pytest.raises(ConfigError, match="not runnable.*OMS is missing"):
        reconcile_by_mapping("M", members, a, b, "OMS", "SHOPIFY", issues=issues)


def test_several_array_levels(spark, put):
    doc = {"batches": [{"rows": [{"k": "a"}, {"k": " b "}]}, {"rows": []}, {"rows": [{"k": None}, {"k": "c"}]}]}
    data, kind = read_side(spark, put("n.json", doc), SideConfig("$.batches[*].rows[*].k"), "x", [])
    assert kind == "JSON" and sorted(r["compare_id"] for r in data.collect()) == ["a", "b", "c"]
    scalars, _ = read_side(spark, put("s.json", {"ids": ["x", "y"]}), SideConfig("$.ids[*]"), "x", [])
    assert sorted((r["compare_id"], r["data"]["value"]) for r in scalars.collect()) == [("x", "x"), ("y", "y")]


def test_scalars_where_objects_are_expected_fail_loudly(spark, put):
    data, _ = read_side(spark, put("s.json", {"ids": ["x"]}), SideConfig("$.ids[*].k"), "x", [])
    with pytest.raises(Exception, match="records are not objects"):
        data.collect()
