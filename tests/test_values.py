"""Comparison, conversion and condition semantics."""

from decimal import Decimal
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from twinledger.functions import values as V
from twinledger.functions.conditions import parse_condition, rule_condition

NUMBER = re.compile(r"-?\d+(\.\d+)?")


def expected_order(a, b):
    if a is None or b is None:
        return 0 if a == b else (-1 if a is None else 1)
    x, y = a.strip("".join(map(chr, range(33)))), b.strip("".join(map(chr, range(33))))
    if NUMBER.fullmatch(x) and NUMBER.fullmatch(y):
        left, right = Decimal(x), Decimal(y)
    else:
        left, right = a, b
    return (left > right) - (left < right)


digits = st.text("0123456789", min_size=1, max_size=30)
number = st.builds(lambda s, w, f: s + w + ("." + f if f else ""), st.sampled_from(["", "-"]), digits,
                   st.one_of(st.just(""), digits))
value = st.one_of(st.none(), number, number.map(lambda n: f" {n}\t"),
                  st.sampled_from(["", "1e3", "10.", ".5", "+1", "abc", "-0", "0.00", "-0.0", "--1", "1 2"]))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(value, value), min_size=60, max_size=120))
def test_order_agrees_with_exact_arithmetic(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = V.Val(F.col("a"), T.StringType()), V.Val(F.col("b"), T.StringType())
    ops = ["=", "!=", ">", "<", ">=", "<="]
    for row in df.select("i", "a", "b", *[V.matches_operator(a, b, op).alias(op) for op in ops]).collect():
        order = expected_order(row["a"], row["b"])
        assert [row[op] for op in ops] == [order == 0, order != 0, order > 0, order < 0, order >= 0, order <= 0], row


def test_doubles_compare_with_text_by_value(spark):
    df = spark.createDataFrame([(1.5e10, "15000000000"), (2.5e-7, "0.00000025"), (10.0, "10"), (-1.25e12, "-1250000000000.0")],
                               "x double, y string")
    same = V.matches_operator(V.Val(F.col("x"), T.DoubleType()), V.Val(F.col("y"), T.StringType()), "=")
    assert [r[0] for r in df.select(same).collect()] == [True] * 4
    assert df.select(V.text_of(V.Val(F.col("x"), T.DoubleType()))).first()[0] == "1.5E+10"


def test_pre_actions(spark):
    row = spark.range(1).select(F.lit("10").alias("a"), F.lit("2").alias("b"), F.lit("not-a-number").alias("c"),
                                F.lit(" 007.50 ").alias("d"), F.lit("99999999999999999999").alias("e"))

    def val(name):
        return V.Val(F.col(name), T.StringType())

    def int_of(name):
        return V.apply_pre_actions(val(name), ["STRING_TO_INT"])

    out = row.select(V.matches_operator(int_of("a"), int_of("b"), ">"), int_of("c").col, int_of("e").col,
                     V.apply_pre_actions(val("d"), "TO_NUMBER").col).first()
    assert list(out) == [True, None, None, "7.50"]
    assert V.pre_action_names(["to_integer", "TO_NUMBER", "TRIM"]) == ["STRING_TO_INT", "STRING_TO_NUMBER"]
    assert V.side_pre_actions(["TO_INT", {"fieldSide": "left", "action": "to_number"}, {"side": "FILE_1", "action": "TO_INT"}]) == {
        "file1": ["STRING_TO_INT", "STRING_TO_NUMBER"], "file2": ["STRING_TO_INT"]}


def test_strict_difference_is_type_sensitive(spark):
    df = spark.range(1).select(F.lit(10).alias("i"), F.lit(10).cast("bigint").alias("l"), F.lit("10").alias("s"),
                               F.lit(10.0).alias("d"), F.lit(None).cast("string").alias("n"))

    def differ(a, b):
        return df.select(V.values_differ(V.Val(F.col(a), df.schema[a].dataType), V.Val(F.col(b), df.schema[b].dataType))).first()[0]

    assert (differ("i", "l"), differ("i", "s"), differ("i", "d"), differ("n", "n"), differ("s", "n")) == (
        False, True, True, False, True)


@pytest.mark.parametrize("text, parsed", [
    ("status not contains Pending", ("status", "not contains", "Pending")),
    ("status is '", ("status", "==", "'")),
    ("qty greater than or equals 10", ("qty", ">=", Decimal(10))),
    ("'qty' < -1.5", ("qty", "<", Decimal("-1.5"))),
    ("active is not TRUE", ("active", "!=", True)),
    ("x equals \"null\"", ("x", "==", "null")),
    ("x equals null", ("x", "==", None)),
    ("x = 1", None), ("", None), ("nonsense", None),
])
def test_parse_condition(text, parsed):
    assert parse_condition(text) == parsed


def test_conditions_on_rows(spark):
    df = spark.createDataFrame([("open", 5, None), (None, 20, "Pending review")], "status string, qty int, note string")

    def flags(text):
        return [r[0] for r in df.select(rule_condition(text, df.schema)).collect()]

    assert flags("note not contains Pending") == [True, False]
    assert flags("note contains Pending") == [False, True]
    assert flags("status is open") == [True, False]
    assert flags("status is not open") == [False, True]
    assert flags("qty > 9.5") == [False, True]
    assert flags("missing > 1") == [False, False]


def test_paths():
    assert V.path_segments("$.a['b c'].d[0]") == ["a", "b c", "d", "0"]
    assert V.path_segments("$") == [] and V.path_segments("a[*].b") == ["a", "*", "b"]
